"""Text functions as column expressions; register(spark) makes the main ones SQL functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

CHUNK, OVERLAP, FOLD = 1500, 200, 80
TOKEN = r"[0-9A-Z_a-z][-.0-9A-Z_a-z]*|[^\x00-\x7F]+"
SEPARATOR = r"[^\p{L}\p{N}\p{Co}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(x), r"(?U)\A\s+|\s+\z", "")


def rstrip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s+\z", "")


def bigrams(x: Column | str) -> Column:
    """Array: ASCII words in lower case, other runs as overlapping pairs of characters (a lone one by itself)."""
    runs = F.regexp_extract_all(_c(x), F.lit(TOKEN), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda t: F.when(F.ascii(t) < 128, F.array(F.lower(t))).otherwise(pairs(t))))


def bigramize(x: Column | str) -> Column:
    return F.array_join(bigrams(x), " ")


def tokens(x: Column | str) -> Column:
    """The index's tokens: bigrams, cut at whatever is neither letter, number nor private-use, in lower case."""
    x = F.lower(_c(x))
    # runs of one class in one pass; most text is ASCII, whose runs are the tokens
    runs = F.regexp_extract_all(x, F.lit(r"[0-9a-z]+|[^\x00-\x7F]+"), F.lit(0))
    pairs = lambda r: F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.split(F.substring(r, i, F.lit(2)), SEPARATOR))), lambda w: w != "")
    mixed = F.flatten(F.transform(runs, lambda r: F.when(F.ascii(r) < 128, F.array(r)).otherwise(pairs(r))))
    return F.when(F.octet_length(x) == F.length(x), runs).otherwise(mixed)


def estimate_tokens(x: Column | str) -> Column:
    """A quarter of the ASCII characters (rounded down) and all others."""
    ascii_ = F.length(F.regexp_replace(_c(x), r"[^\x00-\x7F]", ""))
    return (F.floor(ascii_ / 4) + F.length(_c(x)) - ascii_).cast("int")


def truncate_to_tokens(x: Column | str, most: int) -> Column:
    """The text, or its longest prefix of up to most - 1 tokens, without trailing white space, and an ellipsis."""
    x = _c(x)
    # a prefix of n characters takes between n / 4 and n tokens, so no more than 4 * most characters can fit
    head = F.substring(x, 1, 4 * most + 4)
    fits = F.filter(F.sequence(F.lit(0), F.length(head)), lambda n: estimate_tokens(F.substring(head, F.lit(1), n)) <= most - 1)
    return F.when(estimate_tokens(x) <= most, x).otherwise(F.concat(rstrip(F.substring(head, F.lit(1), F.array_max(fits))), F.lit("…")))


def split_long(x: Column | str, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters, each starting `overlap` before the last one's end."""
    x = _c(x)
    step = size - overlap
    n = F.greatest(F.ceil((F.length(x) - size) / step), F.lit(0)).cast("int")
    return F.when(x.isNotNull(), F.transform(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda i: F.substring(x, i * step + 1, F.lit(size))))


def squeeze(x: Column | str, most: int) -> Column:
    """White space collapsed, stripped and cut."""
    return F.substring(F.regexp_replace(strip(x), r"(?U)\s+", " "), 1, most)


def normalize(x: Column | str) -> Column:
    """The form in which names are compared: without white space, in lower case."""
    return F.lower(F.regexp_replace(_c(x), r"(?U)\s+", ""))


def coerce_type(x: Column | str) -> Column:
    return F.when(_c(x).isin("person", "place", "thing"), _c(x)).otherwise("thing")


def slugify(x: Column | str) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("e"), F.substring(F.sha2(_c(x), 256), 1, 10)))


def month_key(at: Column | str) -> Column:
    """Month in the time's own offset, which is as written."""
    return F.substring(_c(at), 1, 7)


def instant(at: Column | str) -> Column:
    """ISO time to a timestamp; null where it can't be read. Times without an offset are in the session's zone."""
    return F.expr(f"try_to_timestamp({at})") if isinstance(at, str) else F.try_to_timestamp(at)


# ---- single queries, on the driver

_CLASSES = re.compile("[0-9A-Z_a-z][-.0-9A-Z_a-z]*|[ぁ-ゟ]+|[゠-ヿ]+|[々一-鿿]+")
_HIRAGANA = re.compile("[ぁ-ゟ]+")
_PARTICLES = "けど のに ので より など とか のこと だっけ まで から では には って".split()
_CUT = re.compile("|".join(_PARTICLES) + "|[でへにをがはのと]")
#: Grammar that carries no subject; a closed list, so that names in hiragana stay.
_STOP = frozenset(
    "ば わ へ な よ ね か や も と で の を が は に かも しれない しれ いくつ どれ どっち んだけど だけど しそう そうに たまに なの どんな あった ために "
    "てた てる ってた ってる ながら ように ような よう そう みたい なんて なんか どうなって きちんと ちゃんと ちょっと ほしい ください すれば すれ われて られて "
    "なかった いた いい たっけ における ついて なってる やってる もう また でも のに ので かな とか など より まで から ため もの こと だけ けど あの その この "
    "いる ある してる した して ますか ですか だっけ あれ それ これ だれ いつ なん なに どの どう どこ とは って".split()
)


def split_query(question: str) -> list[str]:
    """Terms of a question: runs of one class of characters, hiragana cut at particles and without grammar; the query itself if none is left."""
    out: dict[str, None] = {}
    for run in _CLASSES.findall(question):
        if not _HIRAGANA.fullmatch(run):
            out[run] = None
        elif run not in _STOP:
            out.update(dict.fromkeys(f for f in _CUT.split(run) if len(f) > 1 and f not in _STOP))
    return list(out) or [question]


def split_query_udf():
    @F.pandas_udf("array<string>")
    def terms(q: pd.Series) -> pd.Series:
        return q.map(split_query, na_action="ignore")

    return terms


def tokens_of(text: str) -> list[str]:
    """tokens() of one string, for the terms of a query."""
    out = []
    for run in re.findall(TOKEN, text):
        out += [run.lower()] if run[0].isascii() else [run[i : i + 2] for i in range(max(len(run) - 1, 1))]
    keep = "".join(c if c.isalpha() or c.isnumeric() or _is_letter(c) else " " for c in " ".join(out).lower())
    return keep.split()


#: All but digits and small letters to spaces.
_ASCII_WORDS = "".join(c if c.isdecimal() or c.islower() else " " for c in map(chr, range(128)))
_RUNS = re.compile(r"[0-9a-z]+|[^\x00-\x7F]+")
_kept: dict[str, str] = {}


def words_of(lower: str) -> list[str]:
    """tokens() of one text that is in lower case already."""
    if lower.isascii():
        return lower.translate(_ASCII_WORDS).split()
    out = []
    for run in _RUNS.findall(lower):
        if run[0].isascii():
            out.append(run)
            continue
        for i in range(max(len(run) - 1, 1)):
            pair = run[i : i + 2]
            if (kept := _kept.get(pair)) is None:
                if len(_kept) > 200_000:
                    _kept.clear()
                kept = _kept[pair] = "".join(c if _is_letter(c) else " " for c in pair).strip()
            if kept:
                out.append(kept)
    return out


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


def register(spark: SparkSession) -> None:
    """ts_bigramize, ts_estimate_tokens, ts_normalize and ts_slugify as SQL functions, ts_split_query as a vectorised UDF."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION ts_normalize(x STRING) RETURNS STRING RETURN lower(regexp_replace(x, '(?U)\\s+', ''))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ts_slugify(x STRING) RETURNS STRING RETURN CASE WHEN trim(BOTH '_' FROM regexp_replace(lower(x), '[^a-z0-9]+', '_')) <> '' THEN trim(BOTH '_' FROM regexp_replace(lower(x), '[^a-z0-9]+', '_')) ELSE concat('e', substring(sha2(x, 256), 1, 10)) END")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION ts_estimate_tokens(x STRING) RETURNS INT RETURN CAST(floor(length(regexp_replace(x, '[^\\x00-\\x7F]', '')) / 4) + length(x) - length(regexp_replace(x, '[^\\x00-\\x7F]', '')) AS INT)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION ts_bigramize(x STRING) RETURNS STRING RETURN array_join(flatten(transform(regexp_extract_all(x, '[0-9A-Z_a-z][-.0-9A-Z_a-z]*|[^\\x00-\\x7F]+', 0), t -> CASE WHEN ascii(t) < 128 THEN array(lower(t)) ELSE transform(sequence(1, greatest(length(t) - 1, 1)), i -> substring(t, i, 2)) END)), ' ')")
    spark.udf.register("ts_split_query", split_query_udf())
