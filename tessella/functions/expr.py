"""Column functions for derived variables, with IEEE results where Spark's ANSI mode raises, gives NULL or ranks NaN highest."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def num(x: Column | str | float) -> Column:
    """A DOUBLE column of a column, a column's name or a number."""
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def add_variable(df: DataFrame, name: str, value: Column, title: str | None = None) -> DataFrame:
    """df with a new variable; its name must be an identifier and new (E1). A struct of x, y, z makes a vector."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not an identifier: {name!r}")
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a variable {name!r}")
    out = df.withColumn(name, value)
    kind = out.schema[name].dataType
    if kind.typeName() == "struct":
        if [f.name for f in kind.fields] != ["x", "y", "z"]:
            raise ValueError("a vector has x, y and z")
        out = out.drop(name).withColumns({f"{name}{c.upper()}": value[c] for c in "xyz"})
    elif kind.typeName() not in ("double", "float", "integer", "long", "short", "byte"):
        raise ValueError(f"a variable is a number or a vector, not {kind.simpleString()}")
    return set_title(out, name, title) if title and name in out.columns else out


def set_title(df: DataFrame, name: str, title: str) -> DataFrame:
    """The variable's title, as column metadata."""
    return df.withMetadata(name, {"title": title})


def delete_variable(df: DataFrame, name: str) -> DataFrame:
    """df without a variable; a vector's base name deletes its three components."""
    parts = [f"{name}{c}" for c in "XYZ"]
    if name in df.columns:
        return df.drop(name)
    if all(p in df.columns for p in parts):
        return df.drop(*parts)
    raise ValueError(f"no variable {name!r}")


def div(a, b) -> Column:
    """a / b; division by zero is an infinity or NaN."""
    a, b = num(a), num(b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(F.signum(a) * F.when(F.lit(1.0) / F.when(b == 0, F.lit(1.0)).otherwise(b) < 0, -1.0).otherwise(1.0) > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def power(a, b) -> Column:
    """a ^ b, NaN where it isn't real."""
    return F.pow(num(a), num(b))


def _flag(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def both(a, b) -> Column:
    """1.0 if both are non-zero; NaN is non-zero (E5)."""
    return _flag((num(a) != 0) & (num(b) != 0))


def either(a, b) -> Column:
    """1.0 if one is non-zero (E5)."""
    return _flag((num(a) != 0) | (num(b) != 0))


def sqrt(a) -> Column:
    """NaN below zero."""
    return F.sqrt(num(a))


def least(a, b) -> Column:
    """The smaller; NaN if one is."""
    a, b = num(a), num(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def greatest(a, b) -> Column:
    """The larger; NaN if one is."""
    a, b = num(a), num(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def magnitude(x, y, z) -> Column:
    """Length of a vector."""
    x, y, z = num(x), num(y), num(z)
    return F.sqrt(x * x + y * y + z * z)


def compare(a, op: str, b) -> Column:
    """1.0 or 0.0 for gt, ge, eq, lt, le, ne by IEEE rules: NaN is unequal to all, itself included."""
    a, b = num(a), num(b)
    test = {"gt": a > b, "ge": a >= b, "eq": a == b, "lt": a < b, "le": a <= b, "ne": a != b}[op]
    odd = F.isnan(a) | F.isnan(b)
    return _flag(odd | test) if op == "ne" else _flag(~odd & test)


def log(a) -> Column:
    """Natural logarithm: minus infinity at 0, NaN below."""
    a = num(a)
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(NAN)).when(F.isnan(a), F.lit(NAN)).otherwise(F.ln(F.when(a > 0, a).otherwise(F.lit(1.0))))


def pressure_coefficient(p, p_ref: float, v_ref: float, density: float) -> Column:
    """(p - p_ref) / (density v^2 / 2); a denominator under 1e-12 counts as 1."""
    under = 0.5 * density * v_ref**2
    return (num(p) - F.lit(float(p_ref))) / F.lit(under if abs(under) >= 1e-12 else 1.0)


def von_mises(xx, yy, zz, xy, yz, zx) -> Column:
    """Equivalent stress of six components."""
    xx, yy, zz, xy, yz, zx = map(num, (xx, yy, zz, xy, yz, zx))
    pairs = (xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)
    return F.sqrt(F.lit(0.5) * pairs + F.lit(3.0) * (xy * xy + yz * yz + zx * zx))


def result_magnitude(nodes: DataFrame, results: DataFrame, parts: list[str], name: str) -> DataFrame:
    """nodes (node_id) with the magnitude of up to three result components, 0 where there is no result."""
    total = sum((num(p) * num(p) for p in parts[:3]), F.lit(0.0))
    return nodes.join(results.select("node_id", F.sqrt(total).alias(name)), "node_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def code_names(codes: DataFrame, names: DataFrame, code: str = "code") -> DataFrame:
    """codes with a name for each code: that of the entry (base, name, width) with base <= code < base + width, with the place
    in it where it has several; else CODE<n> (E19). names is a table of codes, not of data: it is small."""
    n = names.select(F.col("base").alias("_b"), F.col("name").alias("_n"), F.col("width").alias("_w"))
    joined = codes.join(F.broadcast(n), (F.col(code) >= F.col("_b")) & (F.col(code) < F.col("_b") + F.col("_w")), "left")
    label = F.when(F.col("_n").isNull(), F.concat(F.lit("CODE"), F.col(code).cast("string"))).when(F.col("_w") > 1, F.concat("_n", F.lit("_"), (F.col(code) - F.col("_b") + 1).cast("string"))).otherwise(F.col("_n"))
    return joined.withColumn("name", label).drop("_b", "_n", "_w")


#: Names of post codes; first codes and stems of tensor families, and the names of a tensor's six parts.
POST_NAMES = {
    7: "Equiv_Plastic_Strain", 8: "Equiv_Creep_Strain",
    9: "Total_Temperature", 10: "Temperature_Increment",
    17: "Equiv_Mises", 20: "Thickness", 38: "Swelling_Strain",
    47: "Equiv_Cauchy", 48: "Strain_Energy_Density", 58: "Elastic_SED",
    78: "Volume",
}
TENSORS = [
    (1, "Strain"), (11, "Stress"), (21, "Plastic_Strain"),
    (301, "Total_Strain"), (311, "Stress"), (321, "Plastic_Strain"),
    (331, "Creep_Strain"), (341, "Cauchy"), (391, "Cauchy_Preferred"),
    (411, "Stress_Global"), (681, "Cauchy"),
]
SIX = ("XX", "YY", "ZZ", "XY", "YZ", "ZX")


def post_name(code: Column | str, label: Column | str | None = None) -> Column:
    """The variable's name for a post code: its label if that has a letter, blanks as underscores; else the code's name, or its
    tensor's and part's; else POST_<n> (E19). The tables are small maps in the expression, no join."""
    code = (F.col(code) if isinstance(code, str) else code).cast("int")
    names = POST_NAMES | {base + k: f"{stem}_{part}" for base, stem in TENSORS for k, part in enumerate(SIX) if base + k not in POST_NAMES}
    known = F.try_element_at(F.create_map(*(F.lit(x) for item in names.items() for x in item)), code)
    out = F.coalesce(known, F.concat(F.lit("POST_"), code.cast("string")))
    if label is None:
        return out
    label = F.regexp_replace(F.trim(F.col(label) if isinstance(label, str) else label), " ", "_")
    return F.when(label.rlike("[A-Za-z]"), label).otherwise(out)


# ---------------------------------------------------------------- coordinates


def rotation(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """The matrix that turns about an axis."""
    n = math.sqrt(sum(a * a for a in axis)) or 1.0
    x, y, z = (a / n for a in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [[c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s], [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s], [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)]]


def to_global(x, y, z, matrix: list[list[float]], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """Local points in global coordinates: matrix times point plus origin (E20). A 4 x 4 matrix carries its own origin."""
    if len(matrix) == 4:
        origin, matrix = tuple(r[3] for r in matrix[:3]), [r[:3] for r in matrix[:3]]
    p = [num(c) for c in (x, y, z)]
    return tuple(sum((F.lit(float(m)) * q for m, q in zip(row, p, strict=True)), F.lit(float(o))) for row, o in zip(matrix, origin, strict=True))


def to_local(x, y, z, matrix: list[list[float]], origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """The inverse of to_global for a rotation."""
    if len(matrix) == 4:
        origin, matrix = tuple(r[3] for r in matrix[:3]), [r[:3] for r in matrix[:3]]
    p = [num(c) - F.lit(float(o)) for c, o in zip((x, y, z), origin, strict=True)]
    return tuple(sum((F.lit(float(matrix[r][c])) * p[r] for r in range(3)), F.lit(0.0)) for c in range(3))


def cylindrical(x, y, z, axis: str = "z") -> tuple[Column, Column, Column]:
    """(r, theta, height) about an axis (E21); about y, theta is atan2(x, z)."""
    x, y, z = num(x), num(y), num(z)
    a, b, h = {"x": (y, z, x), "y": (z, x, y), "z": (x, y, z)}[axis.lower()]
    return F.sqrt(a * a + b * b), F.atan2(b, a), h


def distance(p: tuple, q: tuple) -> Column:
    """Distance of two points given as column triples."""
    return magnitude(*(num(b) - num(a) for a, b in zip(p, q, strict=True)))


def angle(p: tuple, q: tuple, r: tuple) -> Column:
    """Angle at q in degrees; 0 if a side has no length; the cosine is clipped."""
    u, v = [[num(a) - num(b) for a, b in zip(e, q, strict=True)] for e in (p, r)]
    size = magnitude(*u) * magnitude(*v)
    cosine = sum((a * b for a, b in zip(u, v, strict=True)), F.lit(0.0)) / F.when(size < 1e-12, F.lit(1.0)).otherwise(size)
    return F.when(size < 1e-12, F.lit(0.0)).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))))


def scale_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is under 1e-12."""
    return F.when(F.abs(b) < 1e-12, F.lit(0.0)).otherwise(num(a) / F.when(F.abs(b) < 1e-12, F.lit(1.0)).otherwise(num(b)))


def mirrored(df: DataFrame, plane: str) -> DataFrame:
    """df and its copy on the other side of plane yz, zx or xy; column copy is 0 or 1."""
    axis = {"yz": "x", "zx": "y", "xy": "z"}[plane.lower()]
    return df.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(axis, F.when(F.col("copy") == 1, -F.col(axis)).otherwise(F.col(axis)))


def periodic(df: DataFrame, times: int, axis: str = "z") -> DataFrame:
    """times - 1 copies of df turned by 360 k / times degrees about an axis; column copy is k."""
    if times < 2:
        raise ValueError("two copies at least")
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times - 1))))
    turn = F.radians(F.lit(360.0) * F.col("copy") / F.lit(float(times)))
    a, b = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[axis]
    return out.withColumns({a: F.cos(turn) * F.col(a) - F.sin(turn) * F.col(b), b: F.sin(turn) * F.col(a) + F.cos(turn) * F.col(b)})


def vector_bases(names: DataFrame, name: str = "name") -> DataFrame:
    """(base): names less X, Y or Z of which all three are there (H6)."""
    parts = names.select(F.regexp_extract(name, "^(.+)([XYZ])$", 1).alias("base"), F.regexp_extract(name, "^(.+)([XYZ])$", 2).alias("axis")).where("base <> ''")
    return parts.groupBy("base").agg(F.countDistinct("axis").alias("n")).where("n = 3").select("base")
