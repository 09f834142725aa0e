"""Ad-hoc questions over bindings or events as a specification that becomes DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindwell.functions.rules import flag_handsets, mask_table
from bindwell.sources.ingest import export_csv
from bindwell.sources.layouts import Layouts, Manifest

#: Limits of a specification.
DEPTH, CONDITIONS, MEASURES = 6, 40, 10


def where(spec: dict, depth: int = 0) -> Column:
    """A condition tree: {"all"|"any": [...]}, {"not": ...} or {"field", "op", "value"}.

    Not-equal and not-in keep rows whose field is null.
    """
    if depth > DEPTH:
        raise ValueError("conditions are nested too deep")
    for name, join in (("all", and_), ("any", or_)):
        if name in spec:
            return reduce(join, (where(s, depth + 1) for s in spec[name]))
    if "not" in spec:
        return ~F.coalesce(where(spec["not"], depth + 1), F.lit(False))
    c, op, v = F.col(spec["field"]), spec["op"], spec.get("value")
    tests = {
        "=": lambda: c == v, "!=": lambda: c.isNull() | (c != v), ">": lambda: c > v, ">=": lambda: c >= v, "<": lambda: c < v, "<=": lambda: c <= v,
        "between": lambda: c.between(*v), "in": lambda: c.isin(*v), "notIn": lambda: c.isNull() | ~c.isin(*v), "contains": lambda: F.lower(c.cast("string")).contains(str(v).lower()),
        "startsWith": lambda: c.cast("string").startswith(v), "isNull": lambda: c.isNull(), "isNotNull": lambda: c.isNotNull(),
    }
    return tests[op]()


def prefix_ranges(field: str, prefix: str, digits: int) -> Column:
    """A numeric range that says what a digit prefix says, so that column statistics prune the read."""
    unit = 10 ** (digits - len(prefix))
    return F.col(field).between(int(prefix) * unit, (int(prefix) + 1) * unit - 1)


#: Digits of the numeric keys, for which a prefix is a range.
DIGITS = {"msisdn": 10, "imsi": 15}


def route(spec: dict) -> tuple[str, Column | None]:
    """The layout whose key the required conditions name, and a range that says a prefix again for its column statistics."""
    need = spec.get("all", [spec]) if spec else []
    layout, extra = "msisdn", None
    for condition in need:
        field, op = condition.get("field"), condition.get("op")
        if field in ("msisdn", "imsi", "imei") and op in ("=", "in", "startsWith"):
            layout = field
        if field in DIGITS and op == "startsWith" and str(condition["value"]).isdigit() and len(str(condition["value"])) <= DIGITS[field]:
            bounds = prefix_ranges(field, str(condition["value"]), DIGITS[field])
            extra = bounds if extra is None else extra & bounds
    return layout, extra


#: What a condition can say of a model, and how many TACs such conditions are turned into at most.
DEVICE_FIELDS, MOST_TACS = ("manufacturer", "brandName", "modelName", "marketingName", "deviceType", "operatingSystem"), 300
#: Digits of the longest number or SIM.
LONGEST = 15


@dataclass(frozen=True)
class Read:
    """Which copy of the state answers a question, how, and the key ranges (from, up to but not) that it lies in."""

    layout: str
    kind: str
    ranges: tuple[tuple, ...] = ()


def required(spec: dict) -> list[dict]:
    """The conditions that every row must meet: those of the outermost conjunctions."""
    if "all" in spec:
        return [c for s in spec["all"] for c in required(s)]
    return [spec] if "field" in spec else []


def _ranges(field: str, condition: dict) -> tuple[tuple, ...]:
    """Key ranges that a condition on a key, or on a TAC, keeps to."""
    op, value = condition["op"], condition["value"]
    values = value if op == "in" else [value]
    if field == "tac":
        return tuple((v, v + ":") for v in values)  # ":" follows "9"
    if op in ("=", "in"):
        return tuple((v, v + 1) if field in DIGITS else (v, v + "\0") for v in values)
    if field not in DIGITS:
        return ((value, value + ":"),)
    head = str(value)
    # a prefix is one range for every length that a number with it can have
    return tuple((int(head) * 10**k, (int(head) + 1) * 10**k) for k in range(LONGEST - len(head) + 1))


def choose(spec: dict, tacs: list[str] | None = None) -> Read:
    """The copy to read: by an exact key, else by a key's prefix, else by TACs, named or resolved from the catalogue; else all."""
    need = required(spec)
    for kind, ops in (("key", ("=", "in")), ("range", ("=", "in", "startsWith"))):
        for field in ("msisdn", "imsi", "imei"):
            for c in need:
                digits = field not in DIGITS or c.get("op") != "startsWith" or str(c["value"]).isdigit()
                if c["field"] == field and c["op"] in ops and digits:
                    return Read(field, kind, _ranges(field, c))
    for c in need:
        if c["field"] == "tac" and c["op"] in ("=", "in", "startsWith"):
            return Read("imei", "range", _ranges("tac", c))
    if tacs:
        return Read("imei", "range", _ranges("tac", {"op": "in", "value": tacs}))
    return Read("msisdn", "scan")


def resolve_tacs(spec: dict, catalogue: DataFrame) -> list[str] | None:
    """The TACs that the required positive conditions on models name; none if there are no such conditions or too many TACs."""
    asked = [c for c in required(spec) if c["field"] in DEVICE_FIELDS and c["op"] in ("=", "in", "contains", "startsWith")]
    if not asked:
        return None
    found = [r[0] for r in catalogue.where(reduce(and_, map(where, asked))).select("tac").distinct().limit(MOST_TACS + 1).collect()]
    return found if len(found) <= MOST_TACS else None


def routed(layouts: Layouts, manifest: Manifest, spec: dict, catalogue: DataFrame) -> DataFrame:
    """The flagged rows of the state that can answer a specification, read from the copy that fits it best.

    Ranges of the copy are chosen on the driver, row groups by the bounds that stand beside the
    conditions. Columns of the catalogue are there if a condition or a grouping asks for them.
    """
    asked = spec.get("where", {})
    read = choose(asked, resolve_tacs(asked, catalogue))
    if read.kind == "scan":
        rows = layouts.read(read.layout, manifest)
    else:
        ids = sorted({i for low, high in read.ranges for i in layouts.ranges_below(read.layout, low, high)})
        column = F.col(read.layout)
        rows = layouts.read(read.layout, manifest, ids).where(reduce(or_, ((column >= low) & (column < high) for low, high in read.ranges)))
    flagged = flag_handsets(rows, catalogue)
    named = [c for c in DEVICE_FIELDS if c in _fields(asked) | set(spec.get("by", [])) and c in catalogue.columns]
    return flagged.join(catalogue.select("tac", *named), "tac", "left") if named else flagged


def explore_stored(layouts: Layouts, manifest: Manifest, spec: dict, catalogue: DataFrame) -> DataFrame:
    """Answer a specification from the stored copies of the state."""
    return explore(routed(layouts, manifest, spec, catalogue), spec)


def measure(spec: dict) -> Column:
    """count, countDistinct (of a field), min or max, of all rows or of active ones."""
    kind, field = spec["kind"], spec.get("field")
    on = F.lit(True) if not spec.get("active") else F.col("active") == 1
    if kind == "count":
        return F.count_if(on).alias(spec["as"])
    value = F.when(on & (F.length("imei") == 14) if field == "imei" else on, F.col(field))
    return {"countDistinct": F.count_distinct, "min": F.min, "max": F.max}[kind](value).alias(spec["as"])


def _fields(spec: dict) -> set[str]:
    nested = [s for k in ("all", "any") for s in spec.get(k, [])] + ([spec["not"]] if "not" in spec else [])
    return {spec["field"]} if "field" in spec else set().union(set(), *map(_fields, nested))


def explore(df: DataFrame, spec: dict) -> DataFrame:
    """Filter, group, having, sort and page. Rows without a handset are left out unless asked about.

    Sorting ends with the group's own columns, so that pages are stable.
    """
    if len(spec.get("measures", [])) > MEASURES:
        raise ValueError("too many measures")
    asked = _fields(spec["where"]) if "where" in spec else set()
    if len(asked) > CONDITIONS:
        raise ValueError("too many conditions")
    if not asked & {"imei", "tac"} and "no_handset" in df.columns:
        df = df.where("no_handset = 0")
    if "where" in spec:
        df = df.where(where(spec["where"]))
        if (bounds := route(spec["where"])[1]) is not None:
            df = df.where(bounds)
    by = spec.get("by", [])
    out = df.groupBy(*by).agg(*map(measure, spec["measures"])) if spec.get("measures") else df.select(*by)
    if "having" in spec:
        out = out.where(where(spec["having"]))
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in spec.get("sort", [])] + [F.asc(c) for c in by]
    if "limit" in spec:
        out = out.orderBy(*order).offset(spec.get("offset", 0)).limit(spec["limit"])
    return out


def export(df: DataFrame, spec: dict, path: str, masked: bool = True) -> None:
    """The answer to a specification as CSV, with identifiers masked unless asked otherwise."""
    answer = explore(df, spec)
    export_csv(mask_table(answer) if masked else answer, path)
