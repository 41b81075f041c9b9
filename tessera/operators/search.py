"""Word-prefix search, filters, pages and keyset access over accounts."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import without_accents

PAGE, MOST_CHARS, MOST_TOKENS, MOST_KEYSET = 25, 120, 8, 5000
SEARCHED = ("legal_name", "alternate_name", "source_id", "business_number", "city")


def plain(text: Column) -> Column:
    """Lower case without accents; what is no letter or digit stays as it is, and parts words."""
    return F.lower(without_accents(text))


def words_of(text: Column) -> Column:
    """The words of a text, each once: runs of letters and digits. An apostrophe or ampersand parts words, unlike in names."""
    return F.array_distinct(F.filter(F.split(plain(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def query_words(query: str | None) -> list[str]:
    """Words of a search text: runs of letters and digits of its first MOST_CHARS characters, MOST_TOKENS at most."""
    return re.findall(r"[^\W_]+", (query or "").strip()[:MOST_CHARS])[:MOST_TOKENS]


def too_short(query: str | None, words: list[str]) -> bool:
    return bool((query or "").strip()) and all(len(w) < 2 for w in words)


def searched(columns: tuple[str, ...] = SEARCHED) -> Column:
    return F.concat_ws(" ", *(F.col(c) for c in columns))


def index(accounts: DataFrame, key: str = "id", columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """The inverted index (token, key) of the searched columns."""
    return accounts.select(key, F.explode(words_of(searched(columns))).alias("token"))


def sorted_index(tokens: DataFrame) -> DataFrame:
    """The index in the order in which it should be written: a prefix then reads few row groups."""
    return tokens.repartitionByRange("token").sortWithinPartitions("token")


# -- an index kept by layers: rows (key, token, layer), and for keys whose rows of earlier layers are dead (key, layer)

#: Share of dead and added rows from which on the layers are written anew.
MOST_LAYERED = 0.25


def base_layer(accounts: DataFrame, layer: int, key: str = "id", columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    return sorted_index(index(accounts, key, columns).withColumn("layer", F.lit(layer).cast("long")))


def layer_of(changed: DataFrame, known: DataFrame, removed: DataFrame | None, layer: int, key: str = "id", columns: tuple[str, ...] = SEARCHED) -> tuple[DataFrame, DataFrame]:
    """(index rows, dead keys) that a batch adds: `changed` are its new or changed rows, `known` the keys that the index
    has had, `removed` the keys that are gone. Nothing but these rows is read of the accounts."""
    dead = changed.select(key).join(known.select(key), key, "left_semi")
    if removed is not None:
        dead = dead.unionByName(removed.select(key))
    stamp = F.lit(layer).cast("long").alias("layer")
    return base_layer(changed, layer, key, columns), dead.distinct().select(key, stamp)


def live(tokens: DataFrame, dead: DataFrame, key: str = "id") -> DataFrame:
    """The index that the layers stand for: rows that no later layer of their key has put an end to."""
    last = dead.groupBy(key).agg(F.max("layer").alias("_ended"))
    return tokens.join(last, key, "left").filter(F.col("_ended").isNull() | (F.col("layer") >= F.col("_ended"))).drop("_ended", "layer")


def wants_compaction(tokens: DataFrame, dead: DataFrame) -> bool:
    """Whether later layers are more than MOST_LAYERED of the first."""
    n = tokens.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).orderBy("layer").agg(F.min_by("n", "layer").alias("first"), F.sum("n").alias("all")).first()
    return bool(n.all) and n.all - n.first + dead.count() > MOST_LAYERED * n.first


def folded(word: str) -> str:
    """A query's word as the index has it."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c)[0] != "M").lower()


def begins(token: Column, word: str) -> Column:
    """Whether a token begins with a word: a range, which Parquet's statistics can prune."""
    w = folded(word)
    return (token >= w) & (token < w + chr(0x10FFFF)) & F.startswith(token, F.lit(w))


def matching_ids(tokens: DataFrame, words: list[str], key: str = "id") -> DataFrame:
    """Keys for which every word begins some token: one pass over the ranges of the index, counting the words that each key meets."""
    tests = [begins(F.col("token"), w) for w in words]
    near = tokens.filter(reduce(lambda a, b: a | b, tests))
    hits = near.groupBy(key).agg(*(F.max(t).alias(f"w{k}") for k, t in enumerate(tests)))
    return hits.filter(reduce(lambda a, b: a & b, (F.col(f"w{k}") for k in range(len(tests))))).select(key)


def prefix_filter(words: list[str], columns: tuple[str, ...] = SEARCHED) -> Column:
    """The same as a row predicate, for one scan without an index."""
    own = words_of(searched(columns))
    return reduce(lambda a, b: a & b, (F.exists(own, _test(w)) for w in words), F.lit(True))


def _test(word: str):
    return lambda token: begins(token, word)


def filtered(accounts: DataFrame, query: str | None = None, province: str | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """accounts that match; none for a query too short to search. Province is taken as a two-letter code."""
    words = query_words(query)
    if too_short(query, words):
        return accounts.filter(F.lit(False))
    out = accounts
    if words:
        out = out.join(matching_ids(tokens, words), "id", "left_semi") if tokens is not None else out.filter(prefix_filter(words))
    code = (province or "").strip().upper()[:2]
    return out.filter(F.col("province_normalized") == code) if code else out


def page_number(page: float | None, total: int, size: int = PAGE) -> int:
    """page, floored and held between 1 and the last page; 1 for what is no number."""
    last = max(1, -(-total // size))
    if page is None or not math.isfinite(page):
        return 1
    return min(max(1, math.floor(page)), last)


def page_of(rows: DataFrame, page: float | None, order: list[Column | str], total: int | None = None, size: int = PAGE) -> tuple[DataFrame, int, int]:
    """(rows of the page, its number, total)."""
    total = rows.count() if total is None else total
    n = page_number(page, total, size)
    return rows.orderBy(*order).offset((n - 1) * size).limit(size), n, total


def check_keyset(after: int, limit: int, least: int = 0) -> None:
    if after < least or not 1 <= limit <= MOST_KEYSET:
        raise ValueError(f"a keyset page starts at {least} or above and holds 1 to {MOST_KEYSET} rows")


def keyset(rows: DataFrame, key: str = "id", after: int = 0, limit: int = 1000) -> DataFrame:
    check_keyset(after, limit)
    return rows.filter(F.col(key) > after).orderBy(key).limit(limit)


def check_ranked(after_score: int, after_id: int, limit: int) -> None:
    if not 0 <= after_score <= 101:
        raise ValueError("a score lies between 0 and 100")
    check_keyset(after_id, limit)


def ranked_keyset(rows: DataFrame, after_score: int = 101, after_id: int = 0, limit: int = 1000, key: str = "id") -> DataFrame:
    """The next rows by score downwards, then key upwards."""
    check_ranked(after_score, after_id, limit)
    return rows.filter((F.col("score") < after_score) | ((F.col("score") == after_score) & (F.col(key) > after_id))).orderBy(F.desc("score"), key).limit(limit)
