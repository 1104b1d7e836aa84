"""Several values packed in one field: dialect selection by minimum description length.

A dialect is a delimiter (one visible character, white space, or any mix) with a set of quotes.
Lists with the same foreign characters (those no unquoted value may have) form a signature, and
each signature gets the dialect under which all its lists have the shortest description: the bits
of the dialect, of every separator and quoted value, and of the values under a class-bigram code.
The lengths of that code come from counts over all rows. They also price a foreign character that
a dialect leaves inside a value: one that the code has never seen among N characters costs about
log2(2 N) bits and its name, so the more the corpus shows how values look, the more does a missed
separator cost. Both the counts and what the lists need under each dialect are sums of a fixed
number of cells per signature, taken in one distributed pass. Every list is then parsed by the
dialect of its signature with built-in expressions.

Blanks beside a separator belong to it. Where values meet without a separator (``a"b"``) each is an
item. A quote that is never closed separates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialise

# Fixed values of the list format.
VALUE_CHARS = r"A-Za-z0-9_:.+\-"
BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}
QUOTES = "\"'"
#: Delimiters that are no single character.
MIXED, BLANK = "mixed", "blank"
# Bits: name of a character, choice of a mix, a separator, a quoted value, a kind of quote.
NAME_BITS, MIX_BITS, SEPARATOR_BITS, QUOTED_BITS, QUOTE_BITS = 7.0, 8.0, 1.0, 2.0, 2.0
#: Signatures up to this number are broadcast to the lists; more are joined by a shuffle.
BROADCAST_SIGNATURES = 50_000

# White space, as characters and as the inside of a class.
_SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_B = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_QUOTED = {q: f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}" for q in QUOTES}
#: Quotes of a dialect by number: bit 0 is the double quote, bit 1 the single one.
_SETS = ["", '"', "'", "\"'"]
_MARK = "\x01\x01"

# Classes of characters: six kinds of letters, digits and signs of values, the edge of a value.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "_", ":", ".", "+", "-")
EDGE, N_CLASSES = len(_KINDS), len(_KINDS) + 1
_CLASS = np.full(128, EDGE, dtype=np.int64)
for _i, _chars in enumerate(_KINDS):
    _CLASS[[ord(c) for c in _chars]] = _i


class ValueCode:
    """Code lengths, in bits, of values, learned from counts of class pairs."""

    def __init__(self, counts: np.ndarray):
        table = np.asarray(counts, dtype=float).reshape(N_CLASSES, N_CLASSES)
        seen = table.sum(axis=0)
        # Classes with one more for what was never seen in a value.
        mean = np.append(seen + 0.5, 0.5) / (seen.sum() + 0.5 * (N_CLASSES + 1))
        smooth = 2.0
        rows = table.sum(axis=1, keepdims=True)
        self.pair_bits = -np.log2((table + smooth * mean[:N_CLASSES]) / (rows + smooth)) + np.log2([*map(len, _KINDS), 1])
        #: Bits of a foreign character inside a value.
        self.foreign_bits = float(-np.log2(mean[N_CLASSES]) + NAME_BITS)

    def bits(self, pairs: np.ndarray) -> float:
        """Length of all values that have these class pairs."""
        return float((np.asarray(pairs, dtype=float).reshape(N_CLASSES, N_CLASSES) * self.pair_bits).sum())


def strip_list(text: Column) -> Column:
    """Without the blanks at the ends and the brackets around the whole list, however many."""
    trim = lambda x: F.btrim(x, F.lit(_SPACES))
    around = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).isin(*[a + b for a, b in BRACKETS.items()]) & (F.length(x) > 1)
    whole = trim(text)
    opening = F.length(F.regexp_replace(F.regexp_extract(whole, rf"\A[\[({{<{_B}]*", 0), f"[{_B}]", ""))
    inner = F.aggregate(F.sequence(F.lit(1), opening), whole, lambda x, _: F.when(around(x), trim(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x))
    return F.when(around(whole), inner).otherwise(whole)


def signature(text: Column) -> Column:
    """The foreign characters of a list, each once, in order; every white space counts as a blank."""
    foreign = F.translate(F.regexp_replace(text, f"[{VALUE_CHARS}]++", ""), _SPACES, " " * len(_SPACES))
    return F.when(foreign == "", "").otherwise(F.array_join(F.array_sort(F.array_distinct(F.split(foreign, ""))), ""))


class _Buffer:
    """Some lists in one buffer with the classes of their characters."""

    END, OTHER = chr(0xFFFF), chr(0xFFFE)

    def __init__(self, texts: list[str], group: np.ndarray):
        joined = self.END + self.END.join(x.replace(self.END, self.OTHER) for x in texts) + self.END
        self.text, self.cp = joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        self.owner = np.concatenate(([0], np.repeat(np.arange(len(texts)), lengths + 1)))
        self.group = group[self.owner] if len(texts) else np.zeros(1, np.int64)
        self.cls = np.where(self.cp < 128, _CLASS[np.minimum(self.cp, 127)], EDGE)
        space = np.zeros(0x3001, dtype=bool)
        space[[ord(c) for c in _SPACES]] = True
        self.blank = (self.cp <= 0x3000) & space[np.minimum(self.cp, 0x3000)]
        self.seen = (self.cls == EDGE) & ~self.blank & (self.cp != ord(self.END))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, class pair, number) of the value-like stretches."""
        a, b = self.cls[:-1], self.cls[1:]
        inside = (a != EDGE) | (b != EDGE)
        return _counts(self.group[1:][inside], a[inside] * N_CLASSES + b[inside])

    def events(self, quotes: str, has: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, str, np.ndarray]]:
        """(group, character, kind, number) of what a parse with ``quotes`` meets in the lists of
        ``has``: separators that stand outside of quoted values (n), blank runs by the characters
        beside them (beside), blank runs (runs; alone: without such a neighbour), quoted values
        (quoted) and visible characters inside them (inner)."""
        n = len(self.cp)
        inside = np.zeros(n + 1, dtype=np.int64)
        picked = has[self.owner]
        out = []
        if quotes:
            found = [m.span() for m in re.compile("|".join(_QUOTED[q].replace("[^" + q, "[^" + q + self.END) for q in quotes)).finditer(self.text)]
            if found:
                spans = np.array(found, dtype=np.int64)
                spans = spans[picked[spans[:, 0]]]
                np.add.at(inside, spans[:, 0], 1)
                np.add.at(inside, spans[:, 1], -1)
                out.append((*_counts(self.group[spans[:, 0]], np.zeros(len(spans), np.int64)), "quoted"))
        quoted = np.cumsum(inside)[:-1] > 0
        visible = self.seen & picked
        hidden = visible & quoted
        out.append((*_counts(self.group[hidden], np.zeros(int(hidden.sum()), np.int64)), "inner"))
        outer = np.flatnonzero(visible & ~quoted)
        out.append((*_counts(self.group[outer], self.cp[outer]), "n"))
        blank = self.blank & ~quoted & picked
        first = np.flatnonzero(blank & ~np.concatenate(([False], blank[:-1])))
        last = np.flatnonzero(blank & ~np.append(blank[1:], False))
        free = self.seen & ~quoted
        left = np.where(free[first - 1], self.cp[first - 1], 0)
        right = np.where(free[np.minimum(last + 1, n - 1)], self.cp[np.minimum(last + 1, n - 1)], 0)
        group = self.group[first]
        out.append((*_counts(group, np.full(len(first), 32)), "runs"))
        alone = (left == 0) & (right == 0)
        out.append((*_counts(group[alone], np.full(int(alone.sum()), 32)), "alone"))
        beside = np.concatenate((left, np.where(right == left, 0, right)))
        out.append((*_counts(np.concatenate((group, group))[beside > 0], beside[beside > 0]), "beside"))
        return [(g, c, kind, k) for g, c, k, kind in out if len(g)]


def _counts(group: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, number = np.unique(group * 0x110000 + cell, return_counts=True)
    return keys // 0x110000, keys % 0x110000, number


def list_counts(lists: DataFrame) -> DataFrame:
    """(field, signature, quotes, char, kind, n), summed over all lists (field, text, signature):
    all that the description lengths are made of. ``quotes`` is -1 for the class pairs of values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            field, names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).dictionary_encode()
            fields = int(field.max()) + 1
            group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * fields + field
            buffer = _Buffer(batch.column(1).to_pylist(), group)
            signatures = names.dictionary.to_pylist()
            rows = [(-1, "pair", *buffer.pairs())]
            for k, quotes in enumerate(_SETS):
                able = np.array([all(q in s for q in quotes) and s != "" for s in signatures])
                has = able[group // fields]
                if has.any():
                    rows += [(k, kind, g, c, n) for g, c, kind, n in buffer.events(quotes, has)]
            for k, kind, g, c, n in rows:
                m = len(g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g % fields, pa.int32()), names.dictionary.take(pa.array(g // fields)), pa.array(np.full(m, k), pa.int32()), pa.array(c, pa.int32()),
                     pa.array([kind] * m, pa.string()), pa.array(n, pa.int64())], ["field", "signature", "quotes", "char", "kind", "n"])

    counted = lists.select("field", "text", "signature").mapInArrow(count, "field int, signature string, quotes int, char int, kind string, n long")
    return counted.groupBy("field", "signature", "quotes", "char", "kind").agg(F.sum("n").alias("n"))


def value_codes(counts: DataFrame, fields: int) -> list[ValueCode]:
    """The value code of every field from the class pairs of all its lists: a fixed number of cells."""
    tables = np.zeros((fields, N_CLASSES**2))
    for r in counts.where("kind = 'pair'").groupBy("field", "char").agg(F.sum("n").alias("n")).collect():
        tables[r["field"], r["char"]] = r["n"]
    return [ValueCode(t) for t in tables]


def description_lengths(counts: DataFrame, codes: list[ValueCode]) -> DataFrame:
    """(field, signature, quotes, delimiter, bits) of every dialect that the lists allow."""
    per_field = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("field"))
    tables = F.array(*[F.array(*[F.lit(float(x)) for x in c.pair_bits.ravel()]) for c in codes])
    values = counts.where("kind = 'pair'").groupBy("field", "signature").agg(
        F.sum(F.col("n") * F.get(F.get(tables, F.col("field")), F.col("char"))).alias("value_bits"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    chars = counts.where("quotes >= 0").groupBy("field", "signature", "quotes", "char").agg(
        *[of(k).alias(k) for k in ("n", "beside", "runs", "alone", "quoted", "inner")])
    # A quote that the dialect doesn't have never separates, and none is a delimiter of its own.
    quote = F.col("char").isin(*map(ord, QUOTES))
    owned = ((F.col("char") == ord('"')) & (F.col("quotes").bitwiseAND(1) > 0)) | ((F.col("char") == ord("'")) & (F.col("quotes").bitwiseAND(2) > 0))
    parts = F.when(quote & ~owned, 0).otherwise(F.col("n")) + F.col("alone")
    lists = chars.withColumn("parts", parts).groupBy("field", "signature", "quotes").agg(
        F.sum("n").alias("visible"), F.sum("runs").alias("runs"), F.sum("parts").alias("parts"),
        F.sum(F.when(F.col("parts") > 0, F.col("parts") * F.log2(F.col("parts").cast("double"))).otherwise(0.0)).alias("spread"),
        F.sum(F.when(quote & ~owned, F.col("n")).otherwise(0)).alias("alien"),
        (QUOTED_BITS * F.sum("quoted") + SEPARATOR_BITS * F.sum("inner")).alias("quoted_bits"),
        F.collect_list(F.when((F.col("char") > 0) & (F.col("char") != 32) & ~quote, F.struct("char", "n", "beside"))).alias("chars"))
    foreign = per_field([c.foreign_bits for c in codes])
    base = F.coalesce("value_bits", F.lit(0.0)) + F.col("quoted_bits") + QUOTE_BITS * (F.col("quotes").bitwiseAND(1) + F.shiftright("quotes", 1))
    dialect = lambda name, bits: F.struct(bits.alias("bits"), name.alias("delimiter"))
    mix = F.when(F.col("parts") > 0, F.col("parts") * F.log2(F.col("parts").cast("double")) - F.col("spread")).otherwise(0.0)
    every = F.concat(
        F.array(dialect(F.lit(MIXED), base + MIX_BITS + mix + SEPARATOR_BITS * F.col("parts") + foreign * F.col("alien")),
                dialect(F.lit(BLANK), base + NAME_BITS + SEPARATOR_BITS * F.col("runs") + foreign * F.col("visible"))),
        F.transform("chars", lambda c: dialect(_character(c["char"]), base + NAME_BITS + SEPARATOR_BITS * c["n"]
                    + foreign * (F.col("visible") - c["n"] + F.col("runs") - c["beside"]))))
    joined = lists.join(values, ["field", "signature"], "left")
    return joined.select("field", "signature", "quotes", F.explode(every).alias("d")).select("field", "signature", "quotes", "d.delimiter", "d.bits")


def _character(code: Column) -> Column:
    """The character of a code point, also beyond the first plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def dialects(lists: DataFrame, fields: int) -> DataFrame:
    """(field, signature, quotes, delimiter): the cheapest dialect of every signature. Of equally
    cheap ones the one with more quotes is taken."""
    counts = materialise(list_counts(lists))
    lengths = description_lengths(counts, value_codes(counts, fields))
    best = lengths.groupBy("field", "signature").agg(F.min_by(F.struct("quotes", "delimiter"), F.struct(
        F.round("bits", 6), -F.col("quotes"), "delimiter")).alias("d"))
    return best.select("field", "signature", "d.quotes", "d.delimiter")


def split_items(text: Column, quotes: Column, delimiter: Column) -> Column:
    """The places of a list as written, in order (and up to two empty ones at the end). Patterns of
    mixes and blanks are literals; that of a single character is short, since it is compiled
    whenever the delimiter changes from row to row."""
    safe = F.replace(text, F.lit("\x01"), F.lit("\x01\x02"))
    marked = lambda pattern: F.split(F.regexp_replace(safe, pattern, F.lit("$1" + _MARK)), _MARK, -1)
    out = None
    for k, own in enumerate(_SETS):
        alien = "".join(q for q in QUOTES if q not in own)
        if own:
            quoted = "|".join(_QUOTED[q] for q in own)
            mixed = marked(F.lit(rf"({quoted}|[{VALUE_CHARS}{alien}]++)?+(?:[{_B}]*+(?!{quoted})[^{VALUE_CHARS}{_B}{alien}][{_B}]*+|[{_B}]++|\z|(?={quoted}|[{VALUE_CHARS}{alien}]))"))
            blank = marked(F.lit(rf"({quoted}|[^{_B}{own}]++|[{own}])?+(?:[{_B}]++|\z|(?=[^{_B}]))"))
            single = marked(F.concat(F.lit(rf"((?:{quoted}|[^\Q"), delimiter, F.lit(r"\E])*+)(?:\Q"), delimiter, F.lit(r"\E|\z)")))
        else:
            mixed = F.split(safe, rf"[{_B}]*+[^{VALUE_CHARS}{_B}{alien}][{_B}]*+|[{_B}]++", -1)
            blank = F.split(safe, rf"[{_B}]++", -1)
            single = F.split(F.replace(safe, delimiter, F.lit(_MARK)), _MARK, -1)
        items = F.when(delimiter == MIXED, mixed).when(delimiter == BLANK, blank).otherwise(single)
        out = F.when(quotes == k, items) if out is None else out.when(quotes == k, items)
    return out


def unpack_lists(df: DataFrame, row_id: str, fields: list[str], carry: list[str] = ()) -> DataFrame:
    """Every value of the packed ``fields``, one per row: row_id, field, pos (from 0), item, and
    the columns of ``carry``.

    Null and empty lists, ``.`` and empty places give no row, but a place keeps its position. A
    quoted item comes out without its quotes even if it is empty or ``.``. A quote that is never
    closed is a separator. Repeated rows give repeated values (use ``distinct`` first); a null
    row_id is kept; other columns are not read; texts of any length are parsed whole.
    """
    names = [row_id, *[c for c in carry if c != row_id]]
    own = {c: f"__c{i}" for i, c in enumerate(names)}
    packed = F.filter(F.array(*[F.struct(F.lit(i).alias("field"), strip_list(F.col(f"`{c}`")).alias("text")) for i, c in enumerate(fields)]),
                      lambda x: x["text"] != "")
    lists = df.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()], F.explode(packed).alias("l"))
    # Read twice: for the choice of dialects and for the parse.
    lists = materialise(lists.select(*own.values(), F.col("l.field").alias("field"), F.col("l.text").alias("text"), signature(F.col("l.text")).alias("signature")))
    chosen = materialise(dialects(lists, len(fields)))
    if chosen.count() <= BROADCAST_SIGNATURES:
        chosen = F.broadcast(chosen)
    # Lists without a foreign character hold one value and have no dialect.
    placed = lists.join(chosen, ["field", "signature"], "left").select(
        *own.values(), "field", F.coalesce("quotes", F.lit(0)).alias("quotes"), F.posexplode(
            F.when(F.col("quotes").isNull(), F.array("text")).otherwise(split_items(F.col("text"), F.col("quotes"), F.col("delimiter")))).alias("pos", "written"))
    placed = placed.withColumn("written", F.btrim(F.replace("written", F.lit("\x01\x02"), F.lit("\x01")), F.lit(_SPACES)))
    item, is_quoted = F.col("written"), F.lit(False)
    for k, q in enumerate(QUOTES):
        here = (F.col("quotes").bitwiseAND(1 << k) > 0) & F.col("written").startswith(q) & F.col("written").endswith(q) & (F.length("written") > 1)
        item = F.when(here, F.replace(F.substring("written", F.lit(2), F.length("written") - 2), F.lit(q + q), F.lit(q))).otherwise(item)
        is_quoted = is_quoted | here
    out = placed.where(is_quoted | ~F.col("written").isin("", ".")).select(
        *[F.col(x).alias(c) for c, x in own.items()], F.get(F.array(*map(F.lit, fields)), F.col("field")).alias("field"), "pos", item.alias("item"))
    return out.to(T.StructType([df.schema[c] for c in names] + [
        T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())]))
