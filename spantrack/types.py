"""Track formats: the properties that follow from which columns a track has."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import IncompatibleTracksError

RESERVED = ("start", "end", "val", "strand", "id", "edges", "weights")
#: Row-order, region and catalogue columns that aren't part of a track's own columns.
INTERNAL = ("genome", "seqid", "br_idx", "row_ord", "bin", "source_file")
# Numeric missing tokens and the missing value of binary columns.
MISSING_TOKENS = (".", "na", "nan", "n/a", "none")
BINARY_MISSING = -1

# (dense, valued, interval, linked) -> name
TRACK_TYPES = {
    (False, False, False, False): "points",
    (False, True, False, False): "valued points",
    (False, False, True, False): "segments",
    (False, True, True, False): "valued segments",
    (True, False, True, False): "genome partition",
    (True, True, True, False): "step function",
    (True, True, False, False): "function",
    (False, False, False, True): "linked points",
    (False, True, False, True): "linked valued points",
    (False, False, True, True): "linked segments",
    (False, True, True, True): "linked valued segments",
    (True, False, True, True): "linked genome partition",
    (True, True, True, True): "linked step function",
    (True, True, False, True): "linked function",
    (True, False, False, True): "linked base pairs",
}


def val_type(kind: T.DataType | None, name: str | None = None) -> str:
    """Logical value type of a Spark type; ``name`` is the declared one, where the type alone
    can't tell (mean_sd, char)."""
    if name:
        return name
    if kind is None:
        return "none"
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.ByteType | T.BooleanType):
            return "tc_vector"
        if isinstance(inner, T.StringType):
            return "category_vector"
        return "population"
    if isinstance(kind, T.ByteType | T.BooleanType):
        return "tc"
    if isinstance(kind, T.IntegerType | T.LongType | T.ShortType):
        return "number (integer)"
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return "number"
    if isinstance(kind, T.StringType):
        return "category"
    return "unsupported list"


@dataclass(frozen=True)
class TrackFormat:
    """What a track is, as a function of its columns."""

    dense: bool
    valued: bool
    interval: bool
    linked: bool
    has_strand: bool = False
    has_id: bool = False
    weighted: bool = False
    extra: tuple[str, ...] = ()
    value_type: str = "none"
    weight_type: str = "none"

    @classmethod
    def of_columns(cls, columns: dict[str, T.DataType], value_type: str | None = None) -> TrackFormat:
        names = {c for c in columns if c not in INTERNAL}
        return cls(
            dense="start" not in names, valued="val" in names, interval="end" in names, linked="edges" in names,
            has_strand="strand" in names, has_id="id" in names, weighted="weights" in names,
            extra=tuple(c for c in columns if c not in RESERVED and c not in INTERNAL),
            value_type=val_type(columns.get("val"), value_type), weight_type=val_type(columns.get("weights")),
        )

    @classmethod
    def of_schema(cls, schema: T.StructType, value_type: str | None = None) -> TrackFormat:
        return cls.of_columns({f.name: f.dataType for f in schema.fields}, value_type)

    @property
    def represented_dense(self) -> bool:
        """One row per position, without start and end."""
        return (self.valued or self.linked) and self.dense and not self.interval

    @property
    def name(self) -> str:
        return TRACK_TYPES.get((self.dense, self.valued, self.interval, self.linked), "original elements").capitalize()


_TRAITS = ("dense", "valued", "interval", "linked", "has_strand", "has_id", "weighted")


@dataclass(frozen=True)
class TrackFormatReq:
    """A requirement on a format; None leaves a trait open. ``converter`` names a wanted
    conversion of segments to points."""

    dense: bool | None = None
    valued: bool | None = None
    interval: bool | None = None
    linked: bool | None = None
    has_strand: bool | None = None
    has_id: bool | None = None
    weighted: bool | None = None
    value_type: str | None = None
    allow_overlaps: bool | None = None
    borders: str | None = None
    converter: str | None = field(default=None)

    @classmethod
    def named(cls, name: str) -> TrackFormatReq:
        for (dense, valued, interval, linked), known in TRACK_TYPES.items():
            if known == name.lower():
                return cls(dense=dense, valued=valued, interval=interval, linked=linked)
        raise IncompatibleTracksError(f"no track type is called {name}")

    def is_met_by(self, fmt: TrackFormat) -> bool:
        traits = all(getattr(self, x) is None or getattr(self, x) == getattr(fmt, x) for x in _TRAITS)
        return traits and (self.value_type is None or self.value_type == fmt.value_type)

    def merge(self, other: TrackFormatReq) -> TrackFormatReq:
        """Both requirements at once; raises where they contradict each other."""
        out = {}
        for x in self.__dataclass_fields__:
            a, b = getattr(self, x), getattr(other, x)
            if a is not None and b is not None and a != b:
                raise IncompatibleTracksError(f"{x} is required to be {a} and {b}")
            out[x] = a if a is not None else b
        return replace(self, **out)


def overlap_rules(fmt: TrackFormat) -> list[bool]:
    """The variants that make sense: dense tracks can't overlap."""
    return [False] if fmt.dense else [True, False]
