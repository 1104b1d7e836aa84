"""Byte-level BPE of a whole corpus as Spark expressions.

A text is cut into words by the tokenizer's pattern. The merges of a word are a fold: its state
holds the pieces and the rank of every neighbouring pair; each step merges the leftmost pair of the
least rank. Ranks come from a literal map, spread over hash buckets because a lookup in one map
walks through its keys. The most frequent words of the corpus, counted over all texts, are folded
once and go into a second literal map of bounded size; all other words are folded where they stand,
so no word occurrence is ever shuffled.

The fold takes time with the square of its length, so words above LONG bytes are cut first wherever
no token can lie across: where the two bytes are no token and neither of the two triples of bytes
around them occurs in any token. Merges never cross such a place, so the ids stay the same.

Bytes are held as strings of the code points 0 to 255, one per byte, since literal map keys are
strings.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

#: Words held ready in the literal dictionary; a bound on its size, not on what is encoded.
HOT_WORDS = 30_000
RANK_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 15
NO_RANK = 2**31 - 1
#: Bytes of a word above which it is cut before it is folded; buckets of the pairs and triples.
LONG, GRAM_BUCKETS = 48, 1 << 14

# The published word pattern, with white space as Unicode defines it.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^" + _SPACE + r"\p{L}\p{N}]++|["
    + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bucketed(pairs, buckets: int, kind: str) -> Column:
    """A literal array of small maps; the bucket of a key is its CRC-32."""
    table: list[dict] = [{} for _ in range(buckets)]
    for key, value in pairs:
        table[zlib.crc32(key.encode("utf-8")) % buckets][key] = value
    return F.from_json(F.lit(json.dumps(table)), f"array<map<string,{kind}>>")


def _let(value: Column, body) -> Column:
    """``body`` of a lambda variable bound to ``value``, which is then evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lookup(table: Column, buckets: int, key: Column) -> Column:
    return F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int"))[key]


class Bpe:
    """Encoder and decoder for one vocabulary of ranked byte strings."""

    def __init__(self, path: str | None = None):
        self.ranks = read_ranks(path or vocabulary_path())
        self._table = _bucketed(((p.decode("latin-1"), r) for p, r in self.ranks.items()), RANK_BUCKETS, "int")
        grams = {p for p in self.ranks if len(p) == 2} | {p[i : i + 3] for p in self.ranks for i in range(len(p) - 2)}
        self._grams = _bucketed(((g.decode("latin-1"), 1) for g in sorted(grams)), GRAM_BUCKETS, "int")

    def fold(self, word: Column, table: Column, grams: Column) -> Column:
        """Ids of one word by folding its merges with the ranks of ``table`` and the pairs and
        triples of ``grams``, lambda variables (each mention of the literals themselves would be a
        copy of them in the plan)."""

        def rank(piece: Column) -> Column:
            return _lookup(table, RANK_BUCKETS, piece)

        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

        def pair_rank(a: Column, b: Column) -> Column:
            return F.coalesce(rank(F.concat(a, b)), F.lit(NO_RANK))

        def merges(pieces: Column) -> Column:
            size = F.size(pieces)
            start = F.struct(
                pieces.alias("p"),
                F.when(size > 1, F.transform(F.sequence(F.lit(0), size - 2), lambda i: pair_rank(
                    F.get(pieces, i), F.get(pieces, i + 1)))).otherwise(F.array().cast("array<int>")).alias("r"),
            )

            def step(state: Column, _) -> Column:
                p, r = state["p"], state["r"]

                def at(i: Column) -> Column:  # 1-based place of the pair
                    def merged(x: Column) -> Column:
                        n = F.size(p)
                        left = F.when(i > 1, F.array(pair_rank(F.get(p, i - 2), x))).otherwise(F.array().cast("array<int>"))
                        right = F.when(i < n - 1, F.array(pair_rank(x, F.get(p, i + 1)))).otherwise(F.array().cast("array<int>"))
                        return F.struct(
                            F.concat(F.slice(p, 1, i - 1), F.array(x), F.slice(p, i + 2, n)).alias("p"),
                            F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, n)).alias("r"),
                        )

                    return F.when(F.get(r, i - 1) == NO_RANK, state).otherwise(
                        _let(F.concat(F.get(p, i - 1), F.get(p, i)), merged))

                return F.when(F.size(r) == 0, state).otherwise(
                    _let(F.array_position(r, F.array_min(r)).cast("int"), at))

            return F.when(size < 2, F.transform(pieces, rank)).otherwise(
                F.transform(F.aggregate(F.sequence(F.lit(2), size), start, step)["p"], rank))

        def parts(pieces: Column) -> Column:
            """Stretches that no token goes beyond."""
            n = F.size(pieces)

            def gram(first: Column, size: int) -> Column:
                return _lookup(grams, GRAM_BUCKETS, F.concat(*[F.get(pieces, first + i) for i in range(size)])).isNotNull()

            def apart(i: Column) -> Column:  # between the places i - 1 and i
                return ~(gram(i - 1, 2) | ((i > 1) & gram(i - 2, 3)) | ((i < n - 1) & gram(i - 1, 3)))

            def cut(ends: Column) -> Column:
                def one(end: Column, k: Column) -> Column:
                    return _let(F.when(k > 0, F.get(ends, k - 1)).otherwise(0), lambda begin: F.slice(pieces, begin + 1, end - begin))

                return F.transform(ends, one)

            return _let(F.array_append(F.filter(F.sequence(F.lit(1), n - 1), apart), n), cut)

        def ids(pieces: Column) -> Column:
            return F.when(F.size(pieces) > LONG, F.flatten(F.transform(parts(pieces), merges))).otherwise(merges(pieces))

        return _let(raw, lambda x: _let(rank(x), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(
            _let(F.split(x, ""), ids))))

    def _with(self, body) -> Column:
        return _let(self._table, lambda table: _let(self._grams, lambda grams: body(table, grams)))

    @staticmethod
    def words(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))

    def hot_words(self, df: DataFrame, text: str, count: int = HOT_WORDS) -> dict[str, list[int]]:
        """Ids of the ``count`` most frequent words over all rows."""
        words = df.select(F.explode(self.words(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        top = words.orderBy(F.desc("n"), "w").limit(count).select("w")
        spread = top.repartition(df.sparkSession.sparkContext.defaultParallelism, "w")
        return {r["w"]: r["ids"] for r in spread.select("w", self._with(lambda t, g: self.fold(F.col("w"), t, g)).alias("ids")).collect()}

    def encode(self, df: DataFrame, text: str, ids: str = "ids", hot: int = HOT_WORDS) -> DataFrame:
        """``df`` with the ids of ``text``. Empty and null texts have the empty list of ids."""
        known = self.hot_words(df, text, hot)
        table = _bucketed(known.items(), WORD_BUCKETS, "array<int>")

        def coded(ranks: Column, grams: Column) -> Column:
            return _let(table, lambda words: F.flatten(F.transform(self.words(F.col(text)), lambda w: F.coalesce(
                _lookup(words, WORD_BUCKETS, w), self.fold(w, ranks, grams)))))

        return df.withColumn(ids, F.coalesce(self._with(coded), F.array().cast("array<int>")))

    def decode(self, ids: Column) -> Column:
        """Text of a list of ids: its binary pieces in a row; null for null. Bytes that are no
        whole character (ids cut off amid one) become U+FFFD, ids that are none are left out."""
        pieces: list[str] = [""] * (max(self.ranks.values()) + 1)
        for p, r in self.ranks.items():
            pieces[r] = p.decode("latin-1")
        table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
        joined = F.array_join(_let(table, lambda t: F.transform(ids, lambda i: F.get(t, i))), "")
        return F.make_valid_utf8(F.encode(joined, "ISO-8859-1").cast("string"))
