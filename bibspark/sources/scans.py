"""Order and parallelism of scans (S1 - S3, W3): rows numbered in the order of their files, and large
JSON lists read by many tasks.

A JSON list has no line ends to split at. It is read as text cut at every closing brace, which Spark
deals to tasks by byte ranges like lines. Whether a range begins inside a string and how deep it is
nested follows from all ranges before it: a first pass sums up each range (for both states of its begin),
a prefix over these sums, a row a range, gives every range its begin, and a second pass finds the
list's objects. The parts of an object that spans ranges are put together afterwards.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.sources.shared import shared_folder

STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.S)
STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
BRACKET = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\Z)|[\[\]{}]', re.S)
RECORDS_KEY = re.compile(r'"records"\s*:\s*\Z')
ORDINAL = "__ordinal"
#: Characters of a split that are read before its objects are given out.
CHUNK = 1 << 20


# ---------------------------------------------------------------- numbers in file order
def file_splits(df: DataFrame) -> DataFrame | None:
    """df with the path and first byte of the split each row was read from, or None if df is no
    projection of a scan of files."""
    if "_metadata#" not in df._jdf.queryExecution().analyzed().metadataOutput().mkString(" "):
        return None
    return df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"))


def numbered(df: DataFrame, column: str = "ordinal") -> DataFrame:
    """Df with each row's number from 1, in the order of the files' paths and the rows within
    them, however Spark has packed their splits into partitions; rows that are no scan of files are
    numbered in the order of their partitions. Rows are counted by split, so that no task holds them all:
    the window has a row a split. A column that bears a record's number already (ORDINAL) is taken."""
    if ORDINAL in df.columns:
        return df.withColumnRenamed(ORDINAL, column)
    at = F.monotonically_increasing_id()  # the partition, and in the lower 33 bits the place within it
    scan = file_splits(df)
    if scan is None:
        scan = df.withColumns({"__path": F.lit(""), "__block": F.shiftright(at, 33)})
    rows = scan.withColumn("__at", at)
    sizes = rows.groupBy("__path", "__block").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = sizes.select("__path", "__block", (F.sum("__n").over(Window.orderBy("__path", "__block")) - F.col("__n") - F.col("__first")).alias("__before"))
    return rows.join(before, ["__path", "__block"]).withColumn(column, F.col("__before") + F.col("__at") + 1).drop("__path", "__block", "__before", "__at")


# ---------------------------------------------------------------- JSON lists by byte ranges
def depth_change(piece: str, in_string: bool) -> tuple[int, bool]:
    """What a piece of JSON, cut off at a closing brace, does to the depth, brace included, and
    whether it ends inside a string."""
    if in_string:
        end = STRING_END.match(piece)
        if end is None:
            return 0, True
        piece = piece[end.end() :]
    bare = STRING.sub("", piece)
    at = bare.find('"')
    open_string = at >= 0
    if open_string:
        bare = bare[:at]
    change = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    return (change, True) if open_string else (change - 1, False)


def brackets(piece: str, in_string: bool):
    """Places and kinds of the brackets outside strings."""
    start = 0
    if in_string:
        end = STRING_END.match(piece)
        if end is None:
            return
        start = end.end()
    for m in BRACKET.finditer(piece, start):
        if piece[m.start()] != '"':
            yield m.start(), m[0]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    scan = spark.read.option("lineSep", "}").text(path)
    return scan.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _by_split(batches):
    """Yields (path, block, iterator of pieces) for each run of rows from one split."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

    for (path, block), group in groupby(rows(), key=lambda r: r[1:]):
        yield path, block, (r[0] for r in group)


def _split_sums(batches):
    """A row a split: for a begin outside and one inside a string the change of depth and the state at
    the end, and the split's first character."""
    for path, block, pieces in _by_split(batches):
        depth, state, first = [0, 0], [False, True], ""
        for piece in pieces:
            first = first or piece.lstrip("\ufeff \t\r\n")[:1]
            for k in (0, 1):
                change, state[k] = depth_change(piece, state[k])
                depth[k] += change
        yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "d0": [depth[0]], "d1": [depth[1]], "s0": [state[0]], "s1": [state[1]], "first": [first]})


class _Walk:
    """Follows the pieces of a split from its begin state, between the elements of the list."""

    def __init__(self, in_string: bool, depth: int, base: int, inside: bool):
        self.in_string, self.depth, self.base, self.inside = in_string, depth, base, inside

    def piece(self, text: str):
        """Takes a piece. Returns (start, ended): where an element begins in it or None, and
        whether one ends with its brace."""
        start = None
        if self.depth - text.count("]") > self.base:  # below the list's elements up to the brace
            change, self.in_string = depth_change(text, self.in_string)
            self.depth += change
            return None, self.depth == self.base and self.inside
        for at, kind in brackets(text, self.in_string):
            if kind in "{[":
                if self.depth == self.base - 1 and self.base == 2:
                    self.inside = kind == "[" and RECORDS_KEY.search(text, max(0, at - 200), at) is not None
                elif self.depth == self.base and self.inside:
                    start = at
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.base - 1:
                    self.inside = False
                if self.depth == self.base:
                    start = None  # an element that is an array, over within the piece
        self.in_string = depth_change(text, self.in_string)[1]
        ended = False
        if not self.in_string:
            self.depth -= 1
            ended = self.depth == self.base and self.inside
            if self.depth == self.base - 1:
                self.inside = self.base == 1
        return start, ended


def _objects(begins):
    """The elements that end in a split: seq 1 and so on for those wholly inside, 0 for the rest of
    one begun before; and what is left open at its end. closed tells which."""

    def run(batches):
        for path, block, pieces in _by_split(batches):
            in_string, depth, base, inside = begins.value[path, block]
            walk = _Walk(in_string, depth, base, inside)
            held, seq, out, size = [] if depth > base and inside else None, 0, [], 0
            head = held is not None
            for piece in pieces:
                start, ended = walk.piece(piece)
                if held is not None and head and (start is not None or walk.depth <= base and not ended):
                    out.append((0, True, ""))  # an array, begun in an earlier split, is over
                if start is not None:
                    held, head = [piece[start:]], False
                elif held is not None:
                    held.append(piece)
                if ended and held is not None:
                    text = "}".join(held) + "}"
                    if head:
                        out.append((0, True, text))
                    elif text[0] == "{":
                        seq += 1
                        out.append((seq, True, text))
                    held, head = None, False
                elif held is not None and walk.depth <= base:
                    held, head = None, False
                size += len(piece)
                if size >= CHUNK and out:
                    yield _rows(path, block, out)
                    out, size = [], 0
            if held is not None:
                out.append((seq + 1 if not head else 0, False, "}".join(held) + "}"))
            if out:
                yield _rows(path, block, out)

    return run


def _rows(path: str, block: int, out: list) -> pa.RecordBatch:
    n = len(out)
    return pa.RecordBatch.from_pydict({"path": [path] * n, "block": pa.array([block] * n, pa.int64()), "seq": pa.array([o[0] for o in out], pa.int64()), "closed": [o[1] for o in out], "text": [o[2] for o in out]})


def json_objects(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """ordinal, text: the objects of JSON lists (or of the list `records` of an object, unless strict)
    in the order of files and entries; other entries are left out. A file that is no list, or whose
    brackets do not match, is a ValueError (an object that lacks no more than its last brace is read)."""
    pieces = _pieces(spark, path)
    sums = pieces.mapInArrow(_split_sums, "path string, block long, d0 long, d1 long, s0 boolean, s1 boolean, first string").collect()  # a row a split
    begins: dict = {}
    states: dict = {}  # of files: inside a string, depth, depth of the list
    for r in sorted(sums, key=lambda r: (r.path, r.block)):
        if r.path not in states:
            if r.first not in ("[", "{") or (strict and r.first == "{"):
                raise ValueError(f"a list of records is wanted: {r.path}")
            states[r.path] = (False, 0, 1 if r.first == "[" else 2)
        in_string, depth, base = states[r.path]
        begins[r.path, r.block] = [in_string, depth, base, base == 1]
        states[r.path] = (r.s1 if in_string else r.s0, depth + (r.d1 if in_string else r.d0), base)
    for file, (in_string, depth, base) in states.items():
        # every piece counts a brace; the last one of a list has none, that of an object has it
        if in_string or depth != (-1 if base == 1 else 0) and not (base == 2 and depth == -1):
            raise ValueError(f"brackets do not match: {file}")
    context = spark.sparkContext
    if any(base == 2 for _, _, base in states.values()):
        _find_records(spark, pieces, begins)
    found = pieces.mapInArrow(_objects(context.broadcast(begins)), "path string, block long, seq long, closed boolean, text string")
    root = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    found.write.parquet(root)
    found = spark.read.parquet(root)

    whole = found.where("closed and seq > 0").select("path", "block", "seq", "text")
    parts = found.where("not closed or seq = 0")  # two rows a split at most
    order = Window.partitionBy("path").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    grouped = parts.withColumn("nth", F.coalesce(F.sum(F.col("closed").cast("int")).over(order), F.lit(0))).groupBy("path", "nth")
    joined = grouped.agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("p"), F.max("block").alias("block"), F.max(F.col("closed").cast("int")).alias("closed"))
    spanning = joined.where("closed = 1").select("path", "block", F.lit(0).cast("long").alias("seq"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")).where(F.startswith("text", F.lit("{")))
    rows = whole.unionByName(spanning)
    sizes = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("seq").alias("least"))
    before = sizes.select("path", "block", (F.sum("n").over(Window.orderBy("path", "block")) - F.col("n") + (F.col("least") == 0).cast("int")).alias("before"))
    return rows.join(before, ["path", "block"]).select((F.col("before") + F.col("seq")).alias("ordinal"), "text")


def _find_records(spark: SparkSession, pieces: DataFrame, begins: dict) -> None:
    """Sets in begins whether the list `records` of an object is open where a split begins."""
    known = spark.sparkContext.broadcast(dict(begins))

    def run(batches):
        for path, block, group in _by_split(batches):
            ends = []
            for inside in (False, True):
                in_string, depth, base, _ = known.value[path, block]
                ends.append(_Walk(in_string, depth, base, inside))
            for piece in group:
                for walk in ends:
                    walk.piece(piece)
            yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "i0": [ends[0].inside], "i1": [ends[1].inside]})

    inside: dict = {}
    for r in sorted(pieces.mapInArrow(run, "path string, block long, i0 boolean, i1 boolean").collect(), key=lambda r: (r.path, r.block)):
        begins[r.path, r.block][3] = inside.get(r.path, begins[r.path, r.block][2] == 1)
        inside[r.path] = r.i1 if begins[r.path, r.block][3] else r.i0


def read_json_list(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The rows that multiLine gives for lists of objects, by as many tasks as the files have
    splits, with their number in the column ORDINAL. The objects are staged as JSON lines in the shared
    folder, so that later reads of the table are split too."""
    lines = json_objects(spark, path, strict)
    rest = F.regexp_replace(F.substring("text", 2, 2**31 - 1), r"[\r\n]+", " ")
    own = F.concat(F.lit('{"' + ORDINAL + '": '), F.col("ordinal").cast("string"), F.when(F.trim(rest) == "}", F.lit("")).otherwise(F.lit(", ")), rest)
    root = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    lines.select(own.alias("value")).write.text(root)
    return spark.read.json(root)
