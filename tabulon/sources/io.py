"""Readers and writers of record files: CSV with byte order marks, JSON lines, texts, directories, checkpoints."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.functions.semantics import first_per_key, last_wins


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may have wildcards, is there, asked of the file system it belongs to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, quoted_lines: bool = True) -> DataFrame:
    """CSV with a header; byte order marks are skipped, empty cells are null.

    Cells in quotes may hold line ends; files known to have none (``quoted_lines=False``) are split over tasks.
    """
    return spark.read.schema(schema).csv(path, header=True, multiLine=quoted_lines, nullValue="", escape='"', encoding="UTF-8")


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Rows just read from files with a column that orders them by file, part of the file, and line, however files were dealt to tasks."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    return rows.withColumn(name, place)


def read_csv_keyed(spark: SparkSession, path: str | None, schema: StructType | str, key: str) -> DataFrame:
    """As read_csv with the last row of each key, files in order of their names; no path, or one that isn't there, is an empty table. Null keys are left out."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = in_file_order(read_csv(spark, path, schema), "__line")
    return last_wins(rows.where(F.col(key).isNotNull()), [key], "__line").drop("__line")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """One object a line. Blank lines are skipped and malformed lines null; with ``strict`` both are errors when they are read."""
    if not strict:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    lines = spark.read.text(path)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    checked = F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line in JSON lines"))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_splits(spark: SparkSession, paths: dict[str, str], schema: StructType | str, key: str, readable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of several split files in order with ``split``, and per split the rows read, unreadable and repeated.

    ``readable`` says whether a row can be parsed (null: no); other rows are counted and left out, before keys are looked
    at. Of a repeated key the first row in the order of splits and lines stays; blank keys are no key. A missing file is
    an error.
    """
    missing = [p for p in paths.values() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    rows = None
    for i, (s, p) in enumerate(paths.items()):
        part = in_file_order(read_csv(spark, p, schema), "__line").withColumn("split", F.lit(s)).withColumn("__order", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("__ok", F.coalesce(readable, F.lit(False)) if readable is not None else F.lit(True))
    good = rows.where("__ok")
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    kept = first_per_key(good.where(~blank), [key], [F.col("__order"), F.col("__line")]).unionByName(good.where(blank))
    read = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("__ok")).alias("unreadable"))
    stayed = kept.groupBy("split").agg(F.count(F.lit(1)).alias("kept"))
    report = read.join(stayed, "split", "left").select("split", "rows", "unreadable", (F.col("rows") - F.col("unreadable") - F.coalesce("kept", F.lit(0))).alias("repeated"))
    return kept.drop("__order", "__line", "__ok"), report


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; those that end in .gz are unpacked, bytes that are no UTF-8 are replaced."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Names of generated files, with formula, batch, group and number, or only a task's number and group.
NAMED = r"^gen_([A-Za-z][A-Za-z0-9]*?)(?:_(\d+))?_sg(\d+)_(\d+)$"
TASK = r"^gen_task(\d+)_sg(\d+)(?:_|$)"


def generated_files(files: DataFrame, root: str) -> DataFrame:
    """(path, candidate_id, legacy_id, formula, spacegroup) of generated structure files below a root, given their ``path``.

    Standardised copies and names of neither form are left out. Collections are the folders below the root, signs in them as _.
    """
    stem = F.regexp_extract("path", r"([^/]*)\.cif$", 1)
    below = F.regexp_replace(F.expr(f"substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/')) + 1})"), r"/[^/]*$", "")
    collection = F.regexp_replace(F.when(below == "", ".").otherwise(below), "[^A-Za-z0-9.-]", "_")
    df = files.select("path", stem.alias("stem"), collection.alias("collection")).where(F.col("stem").startswith("gen_") & ~F.col("stem").endswith("_std"))
    named, task = F.col("stem").rlike(NAMED), F.col("stem").rlike(TASK)
    legacy = F.when(named, F.expr("substring(stem, 5)")).otherwise(F.col("stem"))
    group = F.when(named, F.regexp_extract("stem", NAMED, 3)).otherwise(F.regexp_extract("stem", TASK, 2)).cast("int")
    formula = F.when(named, F.regexp_extract("stem", NAMED, 1))
    return df.where(named | task).select("path", F.concat_ws("__", "collection", legacy).alias("candidate_id"), legacy.alias("legacy_id"), formula.alias("formula"), group.alias("spacegroup"))


CELL = "struct<lattice:struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>,sites:array<struct<element:string,frac_coords:array<double>>>>"


def read_structures(files: DataFrame) -> DataFrame:
    """(path, structure) of structure files (path, content): CIF with its sites written out, or POSCAR; null where unreadable."""
    import pandas as pd

    from tabulon.sources.structures import parsed_structure

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "structure": [parsed_structure(p, bytes(c).decode("utf-8", "replace")) for p, c in zip(pdf["path"], pdf["content"])]})

    return files.select("path", "content").mapInPandas(run, f"path string, structure {CELL}")


def batches_of(df: DataFrame, value: str, size: int = 50) -> DataFrame:
    """(batch, values): the distinct non-null values in order, in batches for requests to a remote source."""
    from tabulon.operators.skew import running_total
    from tabulon.workspace import Workspace

    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    numbered = running_total(Workspace(df.sparkSession, "batches"), distinct, [], [value], F.lit(1), "__n")
    return numbered.groupBy(F.floor((F.col("__n") - 1) / size).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(value)).alias("values"))


def fetched(batches: DataFrame, fetch: Callable[[list[str]], list[dict]], schema: str, id_: str) -> DataFrame:
    """Records of a remote source: each batch is one request, made in the workers; repeated ids count once (the first batch's)."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def run(parts):
        for pdf in parts:
            for number, values in zip(pdf["batch"], pdf["values"]):
                rows = fetch(list(values))
                yield pd.DataFrame([[number, *[r.get(n) for n in names]] for r in rows], columns=["batch", *names])

    got = batches.repartition("batch").mapInPandas(run, f"batch int, {schema}")
    return first_per_key(got.where(F.col(id_).isNotNull()), [id_], [F.col("batch")]).drop("batch")


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a JSON file that is a list; an empty list is an error."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    if not rows.limit(1).count():
        raise ValueError(f"no entries in {path}")
    return rows


#: What an index of particles by space group holds: modes with essential and accidental particles and the latter's paths.
INDEX = "schema_version int, source string, space_groups map<string,map<string,struct<essential:array<struct<abbreviation:string,name:string>>,accidental:array<struct<abbreviation:string,name:string>>,accidental_paths:map<string,array<struct<line_label:string,path:string,source_pdf_page:int>>>>>>"


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spacegroup, soc, category_ord, category, ord, abbreviation, name) and (spacegroup, soc, abbreviation, ord, line_label,
    path, page) of an index file. Groups other than 1..230 and other modes than with_soc and without_soc are left out."""
    groups = spark.read.schema(INDEX).json(path, multiLine=True).select(F.explode("space_groups").alias("sg", "modes")).select(F.col("sg").try_cast("int").alias("spacegroup"), F.explode("modes").alias("mode", "e"))
    groups = groups.where("spacegroup BETWEEN 1 AND 230 AND mode IN ('with_soc', 'without_soc')").select("spacegroup", (F.col("mode") == "with_soc").alias("soc"), "e")
    part = lambda c, k: groups.select("spacegroup", "soc", F.lit(k).alias("category_ord"), F.lit(c).alias("category"), F.posexplode(f"e.{c}").alias("ord", "p")).select("spacegroup", "soc", "category_ord", "category", "ord", "p.*")
    paths = groups.select("spacegroup", "soc", F.explode("e.accidental_paths").alias("abbreviation", "ps")).select("spacegroup", "soc", "abbreviation", F.posexplode("ps").alias("ord", "p"))
    return part("essential", 0).unionByName(part("accidental", 1)), paths.select("spacegroup", "soc", "abbreviation", "ord", "p.line_label", "p.path", F.col("p.source_pdf_page").alias("page"))


def in_input_order(df: DataFrame, id_: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(df), whose rows keep ``id_``, with the number of each row in df (``place``), by which they may be ordered again."""
    numbered = df.withColumn("place", F.monotonically_increasing_id())
    return work(numbered)


def input_file(folder: str, name: str) -> str:
    """The path of a direct child of a local folder; case doesn't matter if only one fits. Paths out of it, and forms other than CIF and POSCAR, are errors."""
    name = name.strip()
    if not name or os.path.basename(name) != name:
        raise ValueError("the name must be that of a file in the folder")
    there = [f for f in sorted(os.listdir(folder)) if os.path.isfile(os.path.join(folder, f))]
    fits = [f for f in there if f == name] or [f for f in there if f.lower() == name.lower()]
    if len(fits) != 1:
        raise FileNotFoundError(f"no single file {name} in {folder}; there are {', '.join(there)}")
    found = os.path.realpath(os.path.join(folder, fits[0]))
    if os.path.dirname(found) != os.path.realpath(folder):
        raise ValueError("the file must lie in the folder")
    low = fits[0].lower()
    if not (low.endswith((".cif", ".vasp", ".poscar")) or low == "poscar" or low.startswith(("poscar_", "poscar-"))):
        raise ValueError("only .cif, .vasp, .poscar and POSCAR files can be read")
    return found


def read_files(spark: SparkSession, root: str, glob: str = "*", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, folder, content) of all files below a root whose names fit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"), "content")
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*suffixes))
    return files


def preferred_variant(files: DataFrame, key: str, variant: str, order: list[str]) -> DataFrame:
    """Of the files of a key the one whose variant comes first in ``order``; unknown variants are left out."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(variant))
    rest = [c for c in files.columns if c != key]
    known = files.withColumn("__rank", rank).where("__rank > 0")
    return known.groupBy(key).agg(F.min_by(F.struct(*rest), "__rank").alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def jobs_of(files: DataFrame, markers: tuple[str, ...] = ("INCAR", "OUTCAR", "vasprun.xml")) -> DataFrame:
    """(folder path, files) of folders that are named job_… or hold one of the marker files; folders starting with _ are none."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    by = files.groupBy(folder.alias("job_directory")).agg(F.array_sort(F.collect_set("name")).alias("files"))
    name = F.element_at(F.split("job_directory", "/"), -1)
    return by.where(~name.startswith("_") & (name.startswith("job_") | F.arrays_overlap("files", F.array(*[F.lit(m) for m in markers]))))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order with a header, also if there are no rows."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_both(df: DataFrame, path: str, columns: list[str]) -> None:
    """The same rows as CSV and as JSON lines with explicit nulls."""
    write_csv(df, f"{path}/csv", columns)
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/jsonl")


def summary_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text with its nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("summary"))


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet in folders by columns; rows of one folder are written by few tasks."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def label_template(df: DataFrame, id_: str, blanks: list[str]) -> DataFrame:
    return df.select(id_, *[F.lit("").alias(b) for b in blanks])


def digests(files: DataFrame) -> DataFrame:
    """SHA-256 of each file's content."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def write_first_row_header(df: DataFrame, path: str) -> None:
    """CSV of all columns with a header, which is written also if there are no rows."""
    write_csv(df, path, df.columns)


def write_before(df: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], after: str) -> DataFrame:
    """Writes df, then the result of the expensive ``work`` on what was written; if the work fails the first table stays."""
    df.write.mode("overwrite").parquet(path)
    done = work(df.sparkSession.read.schema(df.schema).parquet(path))
    done.write.mode("overwrite").parquet(after)
    return df.sparkSession.read.schema(done.schema).parquet(after)


def append_lines(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, one object each with its nulls, to a folder of finished tasks."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def copy_files(spark: SparkSession, sources: list[str], folder: str) -> list[str]:
    """Copies files into a folder, overwriting, by their file systems; the new paths. A missing source is an error."""
    missing = [s for s in sources if not exists(spark, s)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out = []
    for s in sources:
        a, b = hadoop.Path(s), hadoop.Path(f"{folder.rstrip('/')}/{s.rstrip('/').rsplit('/', 1)[-1]}")
        hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
        out.append(b.toString())
    return out
