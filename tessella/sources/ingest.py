"""Text formats as tables. All take lines (file, line_no, text), as ``lines`` gives them.

A file is read in splits by many tasks. Line numbers come from the number of lines in the splits before; what a line carries
forward from lines above (sections, blocks, running numbers) is found in chunks of CHUNK lines and then over the chunks, so
no file is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans import prefix

NAN = float("nan")
#: Lines of a chunk: what one window sorts.
CHUNK = 1 << 16


def lines(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """(file, line_no, text) of text files, split as Spark's text source splits them; a line ends at \\n or \\r\\n.

    joined: the files of a folder, in the order of their names, are one text (file is the path): so Spark writes a large text.
    A split's rows come in order and their ids rise by one, so a line's number is its id, less the split's first, plus the
    lines of the splits before; only one row for each split is summed in order."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("text")
    )
    file = F.lit(path) if joined else F.col("part")
    splits = raw.groupBy("part", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy(file).orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("part", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return raw.join(base, ["part", "start"]).select(file.alias("file"), (F.col("id") + F.col("base")).alias("line_no"), "text")


def carried(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the last value that isn't NULL up to each line of its file."""
    return prefix.carried(df, value, name, ["file"], "line_no", CHUNK)


def counted(df: DataFrame, many: Column, name: str) -> DataFrame:
    """df with the sum of a number over the lines of its file up to each, itself included."""
    return prefix.counted(df, many, name, ["file"], "line_no", CHUNK)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with 0-based numbers of its lines in each file."""
    return counted(df, F.lit(1), name).withColumn(name, F.col(name) - 1)


def _headed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first line of each file, and the others."""
    first = df.groupBy("file").agg(F.min("line_no").alias("_first"))
    j = df.join(first, "file")
    return j.where("line_no = _first").drop("_first"), j.where("line_no > _first").drop("_first")


def _fields(text: Column, pattern: str = ",") -> Column:
    return F.transform(F.split(text, pattern), lambda x: F.trim(x))


def marc_float(c: Column) -> Column:
    """A number that may have D for E or no letter before its exponent, as in 2.5+1."""
    c = F.regexp_replace(F.upper(F.trim(c)), "D", "E")
    return F.regexp_replace(c, r"^([+-]?\d*\.?\d+|[+-]?\d+\.?)([+-]\d+)$", "$1E$2").try_cast("double")


def bulk_data(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, node_id, x, y, z) and cells (file, cell_id, cell_type, nodes) of free-field cards GRID, CHEXA, CTETRA, CPENTA
    and CPYRAM; comments ($) and bad cards are left out; nodes are renumbered by first use in cells (S12)."""
    from tessella.operators.topology import dense_index

    f = text.where(~F.trim("text").startswith("$")).withColumn("f", _fields(F.col("text")))
    card = F.upper(F.get("f", F.lit(0)))
    grid = f.where(card == "GRID").select("file", F.get("f", F.lit(1)).try_cast("long").alias("raw"), *(F.get("f", F.lit(3 + k)).try_cast("double").alias(c) for k, c in enumerate("xyz"))).where("raw is not null and x is not null and y is not null and z is not null")
    kinds = {"CTETRA": (10, 4), "CHEXA": (12, 8), "CPENTA": (13, 6), "CPYRAM": (14, 5)}
    kind = F.create_map(*(F.lit(v) for k, (t, _) in kinds.items() for v in (k, t)))
    many = F.create_map(*(F.lit(v) for k, (_, n) in kinds.items() for v in (k, n)))
    cells = f.where(card.isin(list(kinds))).select("file", "line_no", F.get("f", F.lit(1)).try_cast("long").alias("cell_id"), kind[card].alias("cell_type"), F.transform(F.slice("f", F.lit(4), many[card]), lambda x: x.try_cast("long")).alias("raw"), many[card].alias("n"))
    cells = cells.where((F.size("raw") == F.col("n")) & F.col("cell_id").isNotNull() & ~F.exists("raw", lambda x: x.isNull()))
    used = cells.select("file", "line_no", F.posexplode("raw").alias("place", "raw")).join(grid.select("file", "raw"), ["file", "raw"], "left_semi").groupBy("file", "raw").agg(F.min(F.struct("line_no", "place")).alias("u")).select("file", "raw", "u.line_no", "u.place")
    number = dense_index(used, ["file", "line_no", "place"], "node_id").select("file", "raw", "node_id")
    j = cells.select("file", "cell_id", "cell_type", F.posexplode("raw").alias("place", "raw")).join(number, ["file", "raw"], "left")
    g = j.groupBy("file", "cell_id", "cell_type").agg(F.array_sort(F.collect_list(F.struct("place", "node_id"))).alias("p"), F.bool_and(F.col("node_id").isNotNull()).alias("whole"))
    return grid.join(number, ["file", "raw"]).select("file", "node_id", "raw", "x", "y", "z"), g.where("whole").select("file", "cell_id", "cell_type", F.transform("p", lambda e: e["node_id"]).alias("nodes"))


def obj(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and faces of v and f lines; f takes the first number of a/b/c, 1-based."""
    f = text.withColumn("f", F.split(F.trim("text"), r"\s+"))
    v = numbered(f.where(F.get("f", F.lit(0)) == "v"), "node_id")
    nodes = v.select("file", "node_id", *(F.get("f", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate("xyz")))
    face = numbered(f.where(F.get("f", F.lit(0)) == "f"), "face_id")
    return nodes, face.select("file", "face_id", F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda x: F.split(x, "/")[0].try_cast("long") - 1).alias("nodes"))


def stl(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and triangles of an ASCII file: three vertices a facet, none shared."""
    f = numbered(text.withColumn("f", F.split(F.trim("text"), r"\s+")).where(F.lower(F.get("f", F.lit(0))) == "vertex"), "node_id")
    nodes = f.select("file", "node_id", *(F.get("f", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate("xyz")))
    facet = F.floor(F.col("node_id") / 3)
    faces = f.groupBy("file", facet.alias("face_id")).agg(F.array_sort(F.collect_list("node_id")).alias("nodes"), F.count("*").alias("n")).where("n = 3")
    return nodes, faces.select("file", "face_id", "nodes")


def ply(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, node_id, values by property name) and faces of an ASCII file, split by its header's counts."""
    f = text.withColumn("f", F.split(F.trim("text"), r"\s+"))
    key = F.get("f", F.lit(0))
    ends = f.where(key == "end_header").groupBy("file").agg(F.min("line_no").alias("end"))
    f = f.join(ends, "file")
    head = f.where("line_no < end")  # a few lines
    count = lambda kind: F.max(F.when((key == "element") & (F.get("f", F.lit(1)) == kind), F.get("f", F.lit(2)).try_cast("long")))
    element = F.last(F.when(key == "element", F.get("f", F.lit(1))), ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no"))
    prop = F.when((key == "property") & (F.col("element") == "vertex"), F.struct("line_no", F.element_at("f", -1).alias("n")))
    names = head.withColumn("element", element).groupBy("file").agg(count("vertex").alias("nv"), count("face").alias("nf"), F.transform(F.array_sort(F.collect_list(prop)), lambda e: e["n"]).alias("names"))
    at = F.col("line_no") - F.col("end") - 1
    body = f.where("line_no > end").join(names, "file")
    nodes = body.where((at >= 0) & (at < F.col("nv"))).select("file", at.alias("node_id"), F.map_from_arrays("names", F.transform(F.slice("f", F.lit(1), F.size("names")), lambda x: x.try_cast("double"))).alias("v"))
    faces = body.where((at >= F.col("nv")) & (at < F.col("nv") + F.coalesce("nf", F.lit(0)))).select("file", (at - F.col("nv")).alias("face_id"), F.transform(F.slice("f", F.lit(2), F.get("f", F.lit(0)).try_cast("int")), lambda x: x.try_cast("long")).alias("nodes"))
    return nodes.select("file", "node_id", F.col("v")["x"].alias("x"), F.col("v")["y"].alias("y"), F.col("v")["z"].alias("z"), F.map_filter("v", lambda k, _: ~k.isin("x", "y", "z")).alias("vars")), faces


def comma_deck(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (4 fields) and 4-, 5-, 6- or 8-node cells (6, 7, 8 or 10 fields: id, kind, nodes)."""
    f = text.withColumn("f", F.transform(F.filter(_fields(F.col("text")), lambda x: x != ""), lambda x: x.try_cast("double"))).where(~F.exists("f", lambda x: x.isNull()))
    n = F.size("f")
    nodes = f.where(n == 4).select("file", F.get("f", F.lit(0)).cast("long").alias("node_id"), *(F.get("f", F.lit(k + 1)).alias(c) for k, c in enumerate("xyz")))
    kind = F.when(n == 6, 10).when(n == 7, 14).when(n == 8, 13).when(n == 10, 12)
    cells = f.where(n.isin(6, 7, 8, 10)).select("file", F.get("f", F.lit(0)).cast("long").alias("cell_id"), kind.alias("cell_type"), F.transform(F.slice("f", F.lit(3), n - 2), lambda x: x.cast("long")).alias("nodes"))
    return nodes, cells


def sectioned_deck(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and cells of a deck with sections coordinates and connectivity; numbers may be Fortran's."""
    word = F.lower(F.split(F.trim("text"), r"[\s,]+")[0])
    s = carried(text.withColumn("marker", F.when(word.rlike("^[a-z]"), word)), "marker", "section")
    s = s.where("marker is null").withColumn("f", F.filter(F.split(F.trim("text"), r"[\s,]+"), lambda x: x != ""))
    nodes = s.where((F.col("section") == "coordinates") & (F.size("f") == 4)).select("file", F.get("f", F.lit(0)).try_cast("long").alias("node_id"), *(marc_float(F.get("f", F.lit(k + 1))).alias(c) for k, c in enumerate("xyz"))).where("node_id is not null and x is not null and y is not null and z is not null")
    many = F.size("f") - 2
    kind = F.when(many == 4, 10).when(many == 5, 14).when(many == 6, 13).when(many == 8, 12)
    cells = s.where((F.col("section") == "connectivity") & kind.isNotNull()).select("file", F.get("f", F.lit(0)).try_cast("long").alias("cell_id"), kind.alias("cell_type"), F.transform(F.slice("f", F.lit(3), many), lambda x: x.try_cast("long")).alias("nodes"))
    return nodes, cells.where(F.col("cell_id").isNotNull() & ~F.exists("nodes", lambda x: x.isNull()))


def node_results(text: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """nodes (node_id) with RES1 .. of lines id v1 v2 ...; ids that aren't nodes are dropped, absent values NaN."""
    f = text.withColumn("f", F.filter(F.split(F.trim("text"), r"[\s,]+"), lambda x: x != ""))
    r = f.select(F.get("f", F.lit(0)).try_cast("long").alias("node_id"), *(marc_float(F.get("f", F.lit(k + 1))).alias(f"RES{k + 1}") for k in range(count))).where("node_id is not null").dropDuplicates(["node_id"])
    return nodes.join(r, "node_id", "left").withColumns({f"RES{k + 1}": F.coalesce(f"RES{k + 1}", F.lit(NAN)) for k in range(count)})


def probe_table(text: DataFrame) -> DataFrame:
    """(file, cycle, time, var, probe, value) of a table whose header names VAR@probe after cycle and time.

    A name that comes again is VAR[place]; short rows and blanks are NaN in place."""
    first, others = _headed(text.where("trim(text) <> ''").withColumn("f", _fields(F.col("text"))))
    head = first.select("file", F.posexplode("f").alias("place", "name"))
    again = Window.partitionBy("file", "name").orderBy("place")
    head = head.withColumn("nth", F.row_number().over(again)).where("place >= 2")
    head = head.select("file", "place", F.when(F.col("nth") > 1, F.concat(F.split("name", "@")[0], F.lit("["), F.col("place").cast("string"), F.lit("]"))).otherwise(F.split("name", "@")[0]).alias("var"), F.get(F.split("name", "@"), F.lit(1)).alias("probe"))
    rows = others.select("file", F.get("f", F.lit(0)).try_cast("int").alias("cycle"), F.get("f", F.lit(1)).try_cast("double").alias("time"), "f")
    return rows.join(head, "file").select("file", "cycle", "time", "var", "probe", F.coalesce(F.get("f", F.col("place")).try_cast("double"), F.lit(NAN)).alias("value"))


def time_series(text: DataFrame) -> DataFrame:
    """(file, cycle, time, var, value) of CSV rows cycle,time,...; bad values are NaN, rows without a cycle or time go."""
    first, others = _headed(text.where("trim(text) <> ''").withColumn("f", _fields(F.col("text"))))
    head = first.select("file", F.posexplode("f").alias("place", "var")).where("place >= 2")
    rows = others.select("file", F.get("f", F.lit(0)).try_cast("int").alias("cycle"), F.get("f", F.lit(1)).try_cast("double").alias("time"), "f").where("cycle is not null and time is not null")
    return rows.join(head, "file").select("file", "cycle", "time", "var", F.coalesce(F.get("f", F.col("place")).try_cast("double"), F.lit(NAN)).alias("value"))


def minmax_blocks(text: DataFrame) -> DataFrame:
    """(file, block, name, lo, hi, current) of blocks that end at /, LAST or the next CRDL; ends that are the wrong way round
    are swapped; the last block is the current one (S21, W8)."""
    first = F.upper(F.split(F.trim("text"), r"[\s,]+")[0])
    stop = first.isin("/", "LAST", "CRDL")
    b = counted(text.withColumn("stop", F.coalesce(stop.cast("int"), F.lit(0))), F.col("stop"), "raw")
    f = b.where("stop = 0").withColumn("f", F.filter(F.split(F.trim("text"), r"[\s,]+"), lambda x: x != ""))
    v = f.select("file", "raw", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).try_cast("double").alias("a"), F.get("f", F.lit(2)).try_cast("double").alias("b")).where("a is not null and b is not null")
    blocks = numbered(v.select("file", F.col("raw").alias("line_no")).distinct(), "block")  # those with a row
    last = blocks.groupBy("file").agg(F.max("block").alias("_last"))
    v = v.join(blocks.withColumnRenamed("line_no", "raw"), ["file", "raw"]).join(last, "file")
    return v.select("file", (F.col("block") + 1).cast("int").alias("block"), "name", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("block") == F.col("_last")).alias("current"))


def minmax_csv(text: DataFrame) -> DataFrame:
    """(file, name, lo, hi) of CSV rows var,min,max under a header; bad rows go."""
    f = text.withColumn("f", _fields(F.col("text")))
    return f.select("file", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).try_cast("double").alias("lo"), F.get("f", F.lit(2)).try_cast("double").alias("hi")).where("lo is not null and hi is not null")


XDMF = "Grid array<struct<_Name:string,_GridType:string,_CollectionType:string,Grid:array<struct<_Name:string,Time:struct<_Value:double>,Topology:struct<_TopologyType:string,_NumberOfElements:long,DataItem:struct<_VALUE:string>>,Geometry:struct<DataItem:struct<_VALUE:string>>,Attribute:array<struct<_Name:string,_Center:string,DataItem:struct<_VALUE:string>>>>>>>"


def xdmf(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, time, mesh_frame, xyz, connectivity, name, center, values) of inline data in a temporal collection.

    A frame without mesh has that of the last frame before it that has; a frame without a time has its number."""
    d = spark.read.format("xml").option("rowTag", "Domain").schema(XDMF).load(path).withColumn("file", F.input_file_name())
    g = d.select("file", F.explode("Grid").alias("c")).select("file", F.posexplode("c.Grid").alias("frame", "g"))
    num = lambda c: F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    g = g.select("file", "frame", F.coalesce("g.Time._Value", F.col("frame").cast("double")).alias("time"), num(F.col("g.Geometry.DataItem._VALUE")).alias("xyz"), num(F.col("g.Topology.DataItem._VALUE")).alias("connectivity"), F.col("g.Attribute").alias("attributes"))
    w = Window.partitionBy("file").orderBy("frame")
    g = g.withColumns({"mesh_frame": F.last(F.when(F.col("xyz").isNotNull(), F.col("frame")), ignorenulls=True).over(w), "xyz": F.last("xyz", ignorenulls=True).over(w), "connectivity": F.last("connectivity", ignorenulls=True).over(w)})
    return g.withColumn("a", F.explode_outer("attributes")).select("file", "frame", "time", "mesh_frame", "xyz", "connectivity", F.col("a._Name").alias("name"), F.col("a._Center").alias("center"), num(F.col("a.DataItem._VALUE")).alias("values"))


#: Elements whose text is data, and those that name what follows.
_TAG = r"<(/?)([A-Za-z]+)([^<>]*?)(/?)>"


def xdmf_values(text: DataFrame) -> DataFrame:
    """(file, frame, time, item, name, center, place, value): every number of inline data of a temporal collection, one row
    each; item is Topology, Geometry or Attribute (S23).

    Lines may break anywhere but within a tag or a number. Each line is cut into tags and texts; the grid, its time, the open
    element and the attribute are carried forward over lines and chunks, and numbers are counted within their element."""
    cut = F.filter(F.split(F.regexp_replace("text", r"(<[^<>]*>)", "\n$1\n"), "\n"), lambda x: F.trim(x) != "")
    parts = text.select("file", F.col("line_no").alias("_line"), F.posexplode(cut).alias("_at", "part"))
    # a line has fewer than 2^20 parts: the order within it goes into the number
    s = parts.select("file", (F.col("_line") * (1 << 20) + F.col("_at")).alias("line_no"), F.trim("part").alias("part"))
    attribute = lambda key: F.nullif(F.regexp_extract("part", key + r"\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    tag = F.regexp_extract("part", _TAG, 2)
    opens = F.col("part").startswith("<") & ~F.col("part").startswith("</") & ~F.col("part").startswith("<?") & ~F.col("part").startswith("<!")
    s = s.withColumns({"tag": F.when(opens, tag), "kind": F.when(opens, attribute("GridType"))})
    grid = (F.col("tag") == "Grid") & F.coalesce(F.col("kind") != "Collection", F.lit(True))
    s = _counted_wide(s.withColumn("_grid", F.coalesce(grid.cast("int"), F.lit(0))), "_grid", "frame").where("frame > 0")
    item = F.when(F.col("tag").isin("Topology", "Geometry", "Attribute", "Time"), F.struct("tag", attribute("Name").alias("name"), attribute("Center").alias("center"), F.col("line_no").alias("begin")))
    s = _carried_wide(s.withColumn("_item", item), "_item", "item")
    times = s.where("tag = 'Time'").groupBy("file", "frame").agg(F.min(attribute("Value").try_cast("double")).alias("time"))
    texts = s.where(~F.col("part").startswith("<") & F.col("item.tag").isin("Topology", "Geometry", "Attribute"))
    numbers = texts.withColumn("v", F.filter(F.split("part", r"\s+"), lambda x: x != "")).withColumn("_n", F.size("v"))
    # within an element: the count up to a part, less the count up to the element's first part
    numbers = _counted_wide(numbers, "_n", "upto").withColumn("before", F.col("upto") - F.col("_n"))
    first = numbers.groupBy("file", F.col("item.begin").alias("begin")).agg(F.min("before").alias("base"))
    n = numbers.withColumn("begin", F.col("item.begin")).join(first, ["file", "begin"]).join(times, ["file", "frame"], "left")
    frame = F.col("frame") - 1
    out = n.select("file", frame.alias("frame"), F.coalesce("time", frame.cast("double")).alias("time"), F.col("item.tag").alias("item"), F.col("item.name").alias("name"), F.col("item.center").alias("center"), (F.col("before") - F.col("base")).alias("base"), F.posexplode("v").alias("k", "x"))
    return out.select("file", "frame", "time", "item", "name", "center", (F.col("base") + F.col("k")).alias("place"), F.col("x").try_cast("double").alias("value"))


def _wide(df: DataFrame, how) -> DataFrame:
    """how() over rows whose line numbers leave room for the places in a line: chunks of as many lines."""
    return how(df.withColumn("_no", F.col("line_no")).withColumn("line_no", F.col("line_no") / F.lit(1 << 20))).withColumn("line_no", F.col("_no")).drop("_no")


def _counted_wide(df: DataFrame, many: str, name: str) -> DataFrame:
    return _wide(df, lambda d: counted(d, F.col(many), name)).drop(many) if many == "_grid" else _wide(df, lambda d: counted(d, F.col(many), name))


def _carried_wide(df: DataFrame, value: str, name: str) -> DataFrame:
    return _wide(df, lambda d: carried(d, value, name)).drop(value)


def xdmf_mesh_frames(values: DataFrame) -> DataFrame:
    """(file, frame, mesh_frame): the last frame up to each that has coordinates, NULL before any (S23); frames, not values."""
    f = values.groupBy("file", "frame").agg(F.max((F.col("item") == "Geometry").cast("int")).alias("own"))
    w = Window.partitionBy("file").orderBy("frame")
    return f.select("file", "frame", F.last(F.when(F.col("own") == 1, F.col("frame")), ignorenulls=True).over(w).alias("mesh_frame"))


def particle_frames(blocks: DataFrame, velocities: DataFrame | None = None) -> DataFrame:
    """(frame, particle_id, x, y, z, vx, vy, vz) of blocks (block_no, values): three of one length make a frame, a rest is
    dropped; velocities (frame, particle_id, vx, vy, vz) join by frame and particle, else 0 (S24)."""
    b = blocks.withColumn("n", F.size("values"))
    same = Window.orderBy("block_no")  # block headers, not particles
    heads = b.select("block_no", "n").withColumn("new", F.when(F.lag("n").over(same) == F.col("n"), 0).otherwise(1)).withColumn("run", F.sum("new").over(same))
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("block_no")) - 1).withColumns({"triple": F.floor(F.col("place") / 3), "axis": F.col("place") % 3})
    whole = heads.withColumn("k", F.count("*").over(Window.partitionBy("run", "triple"))).where("k = 3")
    numbered = whole.withColumn("frame", F.dense_rank().over(Window.orderBy("run", "triple")) - 1).select("block_no", "frame", "axis")
    long_ = b.join(F.broadcast(numbered), "block_no").select("frame", "axis", F.posexplode("values").alias("particle_id", "v"))
    xyz = long_.groupBy("frame", "particle_id").agg(*(F.max(F.when(F.col("axis") == k, F.col("v"))).alias(c) for k, c in enumerate("xyz"))).withColumn("particle_id", F.col("particle_id").cast("long"))
    if velocities is None:
        return xyz.withColumns({c: F.lit(0.0) for c in ("vx", "vy", "vz")})
    return xyz.join(velocities, ["frame", "particle_id"], "left").na.fill(0.0, ["vx", "vy", "vz"])


def merge_zones(nodes: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (zone, node_id, ...) and cells (zone, cell_id, nodes) of several zones as one mesh: ids are shifted by the sizes of
    the zones before (S26). Fields that only some zones have come as NaN; see merge_fields."""
    size = nodes.groupBy("zone").agg((F.max("node_id") + 1).alias("n")).join(cells.groupBy("zone").agg((F.max("cell_id") + 1).alias("m")), "zone", "left")
    w = Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)  # zones
    shift = F.broadcast(size.select("zone", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_n"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("_m")))
    n = nodes.join(shift, "zone").withColumn("node_id", F.col("node_id") + F.col("_n")).drop("_n", "_m")
    c = cells.join(shift, "zone").withColumns({"cell_id": F.col("cell_id") + F.col("_m"), "nodes": F.transform("nodes", lambda x: x + F.col("_n"))}).drop("_n", "_m")
    return n, c


def merge_fields(parts: list[DataFrame]) -> DataFrame:
    """Zone tables one under the other; a field that a zone lacks is NaN there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill(NAN)


def field_location(values: DataFrame) -> DataFrame:
    """(var, location) of a long field (var, location, value) merged both ways: nodes unless the cells' has more finite values."""
    finite = F.count_if(~F.isnan("value") & (F.abs("value") < float("inf")))
    g = values.groupBy("var").pivot("location", ["node", "cell"]).agg(finite)
    return g.select("var", F.when(F.coalesce("cell", F.lit(0)) > F.coalesce("node", F.lit(0)), "cell").otherwise("node").alias("location"))
