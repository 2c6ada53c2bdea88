"""Logs and reports of calculations as tables: last values and markers, band tables, species tables, path listings, indices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import expand_ranges
from tabulon.operators.series import carry_forward, lines_of
from tabulon.operators.tables import first_seen_list, longest_first, per_unit

_NUMBER = r"([-+0-9.Ee]+)"
#: What a job's log says of energies, sites and time, and the signs of its ends.
LOG_VALUES = {"total_energy": rf"free\s+energy\s+TOTEN\s*=\s*{_NUMBER}", "sigma_zero_energy": rf"energy\(sigma->0\)\s*=\s*{_NUMBER}", "ions": r"NIONS\s*=\s*(\d+)", "elapsed": rf"Elapsed time \(sec\):\s*{_NUMBER}"}
FINISHED = ("General timing and accounting informations for this job", "Voluntary context switches")
ELECTRONIC, IONIC = "EDIFF is reached", "reached required accuracy"


def last_match(text: Column, pattern: str) -> Column:
    """The first group of the last match; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return F.greatest(F.lit(False), *[text.contains(p) for p in parts])


def job_logs(df: DataFrame, text: str, stage: Column, atoms: Column | None = None) -> DataFrame:
    """df with what its log text says at last: energies, atoms (those given, else the log's), energy per atom (the one
    extrapolated to zero smearing first), elapsed seconds, whether the job is complete, electronically and, of relaxations, ionically
    converged. Null texts have an error and nulls; unreadable numbers are null.
    """
    t = F.col(text)
    total, zero, elapsed = (last_match(t, LOG_VALUES[k]).try_cast("double") for k in ("total_energy", "sigma_zero_energy", "elapsed"))
    n = F.coalesce(*([atoms] if atoms is not None else []), last_match(t, LOG_VALUES["ions"]).try_cast("int"))
    there = t.isNotNull()
    done = total.isNotNull() & (any_of(t, FINISHED) | elapsed.isNotNull())
    return df.withColumns({
        "total_energy": total, "sigma_zero_energy": zero, "atoms": n, "elapsed": elapsed, "energy_per_atom": per_unit([zero, total], n), "complete": F.coalesce(done, F.lit(False)),
        "electronic_converged": F.when(there, t.contains(ELECTRONIC)), "ionic_converged": F.when(there & (stage == "relax"), t.contains(IONIC)), "log_error": F.when(~there, "log missing"),
    })


def band_report(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, knum, kname, k, bnd, eigval, irrep): the band tables of reports, degenerate bands once for each of their number.

    ``knum = n kname= x`` opens a point, ``k = a b c`` gives its coordinates, a line with bnd and eigval opens its table,
    a blank line or one of stars closes it. Lines before a point, outside a table or unreadable are left out.
    """
    lines = lines_of(df, key, text).withColumn("line", F.trim("line"))
    point = F.regexp_extract("line", r"^knum\s*=\s*(\d+).*?kname=\s*(\S*)", 1)
    lines = carry_forward(lines, [key], "line_no", F.nullif(point, F.lit("")).cast("int"), "knum")
    opens = F.col("line").startswith("bnd") & F.col("line").contains("eigval")
    closes = (F.col("line") == "") | F.col("line").startswith("***") | F.col("line").startswith("knum")
    lines = carry_forward(lines, [key], "line_no", F.when(opens, True).when(closes, False), "inside")
    kname = F.nullif(F.regexp_extract("line", r"^knum\s*=\s*(\d+).*?kname=\s*(\S*)", 2), F.lit(""))
    places = F.slice(F.regexp_extract_all("line", F.lit(r"(-?\d+\.\d+)"), 1), 1, 3)
    heads = lines.where("knum IS NOT NULL").groupBy(key, "knum").agg(F.max(F.when(point != "", kname)).alias("kname"), F.max_by(F.when(F.col("line").startswith("k =") & (F.size(places) == 3), places.cast("array<double>")), F.when(F.col("line").startswith("k =") & (F.size(places) == 3), F.col("line_no"))).alias("k"))
    row = r"^(\d+)\s+(\d+)\s*(-?\d+\.\d+)[^=]*=(.*)$"
    got = lambda g: F.regexp_extract("line", row, g)
    bands = lines.where(F.col("inside") & F.col("knum").isNotNull() & F.col("line").rlike(row)).select(key, "knum", "line_no", got(1).cast("int").alias("bnd"), got(2).cast("int").alias("times"), got(3).cast("double").alias("eigval"), F.trim(got(4)).alias("irrep"))
    each = bands.where("times > 0").withColumn("step", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("bnd", F.col("bnd") + F.col("step"))
    return each.join(heads, [key, "knum"]).select(key, "knum", "kname", "k", "bnd", "eigval", "irrep")


def species_tables(df: DataFrame, key: str, text: str, species: list[str]) -> DataFrame:
    """(key, section, species, expression): tables of pages with an essential and an accidental part.

    A line that starts with a species (the longest one that fits) and a blank opens its range expression; lines of
    digits, commas and hyphens go on with it. Lines before a part's heading, or of no species, are left out.
    """
    clean = F.trim(F.regexp_replace(F.replace(F.col("line"), F.lit("–"), F.lit("-")), r"\s+", " "))
    lines = lines_of(df, key, text).withColumn("line", clean)
    heading = F.when(F.col("line").startswith("The essential degeneracies"), "essential").when(F.col("line").startswith("The accidental degeneracies"), "accidental")
    lines = carry_forward(lines, [key], "line_no", heading, "section").where("section IS NOT NULL")
    order = sorted(species, key=lambda s: (-len(s), s))
    head = F.coalesce(*[F.when(F.col("line").startswith(f"{s} "), s) for s in order])
    goes_on = F.col("line").rlike(r"^[\d,\-\s]+$")
    # a heading ends the species before it; other lines leave it open
    mark = F.when(heading.isNotNull(), F.struct(F.lit(None).cast("string").alias("s"), F.col("line_no").alias("n"))).when(head.isNotNull(), F.struct(head.alias("s"), F.col("line_no").alias("n")))
    lines = carry_forward(lines, [key], "line_no", mark, "open")
    own = F.when(head.isNotNull(), F.trim(F.expr("substring(line, length(open.s) + 1)"))).when(goes_on, F.col("line"))
    parts = lines.where(F.col("open.s").isNotNull()).select(key, "section", F.col("open.s").alias("species"), F.col("open.n").alias("n"), "line_no", own.alias("part")).where("part IS NOT NULL")
    whole = parts.groupBy(key, "section", "species", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda s: s["part"]), " ").alias("expression"))
    return whole.groupBy(key, "section", "species").agg(F.max_by("expression", "n").alias("expression"))


def path_listing(pages: DataFrame, book: str, page: str, text: str, aliases: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(book, spacegroup, abbreviation, line_label, path, page): paths by space group from the pages of a book, in order.

    ``SG n`` lines open a block that runs on over pages; ``label; path;`` lines open an entry; entries name particles by
    aliases, of which the longest at a place counts. An entry's page is that of its heading. Numbers outside 1..230 are left out.
    """
    lines = lines_of(pages.select(F.struct(book, page).alias("at"), text), "at", text).select(F.col(f"at.{book}").alias(book), F.col(f"at.{page}").alias(page), "line_no", "line")
    place = F.struct(page, "line_no")
    lines = lines.withColumn("place", place)
    group = F.nullif(F.regexp_extract("line", r"^SG (\d+)\s*$", 1), F.lit("")).cast("int")
    entry = r"^([^\s\d{][^;,\n]{0,7}?)\s*;\s*([^;,\s{}]{1,12})\s*;"
    head = F.when(F.col("line").rlike(entry), F.struct(F.trim(F.regexp_extract("line", entry, 1)).alias("label"), F.regexp_extract("line", entry, 2).alias("path"), F.col(page).alias("page"), F.col("place").alias("at")))
    lines = carry_forward(lines, [book], "place", F.when(group.isNotNull(), F.struct(group.alias("g"), F.col("place").alias("at"))), "block")
    lines = carry_forward(lines, [book], "place", head, "entry").where("block IS NOT NULL AND entry IS NOT NULL AND entry.at > block.at AND block.g BETWEEN 1 AND 230")
    named = lines.select(book, F.col("block.g").alias("spacegroup"), F.col("entry.label").alias("line_label"), F.col("entry.path").alias("path"), F.col("entry.page").alias("page"), F.explode(F.regexp_extract_all("line", F.lit(r"(?<![A-Za-z0-9-])(?:" + longest_first(list(aliases))[5:-3] + r")(?![A-Za-z0-9-])"), 0)).alias("alias"))
    known = F.create_map(*[x for a, names in aliases.items() for x in (F.lit(a), F.array(*[F.lit(n) for n in names]))])
    return named.select(book, "spacegroup", F.explode(known[F.col("alias")]).alias("abbreviation"), "line_label", "path", "page").distinct()


def particle_index(tables: DataFrame, paths: DataFrame, mode: str) -> DataFrame:
    """(mode, spacegroup, category, particles): the index of particles by space group from species tables (mode, section,
    species, expression) and path listings (mode, spacegroup, abbreviation). Particles with a path but in no table are
    accidental. Range expressions are spread to groups 1..230, the rest of them left out.
    """
    listed = tables.select(mode, F.col("section").alias("category"), F.col("species").alias("particle"), F.explode(expand_ranges(F.regexp_replace("expression", r"\s+", ""))).alias("spacegroup")).where("spacegroup BETWEEN 1 AND 230")
    found = paths.select(mode, F.lit("accidental").alias("category"), F.col("abbreviation").alias("particle"), "spacegroup").distinct()
    added = found.join(listed, [mode, "category", "particle", "spacegroup"], "left_anti")
    both = listed.withColumn("ord", F.lit(0)).unionByName(added.withColumn("ord", F.lit(1)))
    return first_seen_list(both, [mode, "spacegroup", "category"], "particle", ["ord", "particle"], "particles")


def single_job(jobs: DataFrame, key: str, needed: tuple[str, ...]) -> DataFrame:
    """(key, job_directory): the one job of each key that has all the files; none or several is an error that says so.

    jobs: key, job_directory, files (array).
    """
    fit = F.forall(F.array(*[F.lit(n) for n in needed]), lambda n: F.array_contains("files", n))
    by = jobs.groupBy(key).agg(F.count_if(fit).alias("n"), F.min(F.when(fit, F.col("job_directory"))).alias("job_directory"))
    told = F.concat(F.lit("expected one complete job of "), F.col(key).cast("string"), F.lit(", found "), F.col("n").cast("string"))
    return by.select(key, F.when(F.col("n") == 1, F.col("job_directory")).otherwise(F.raise_error(told)).alias("job_directory"))


def band_values(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, spin, k, band, energy, occupation): the eigenvalues of an XML result, all counted from 1; unreadable texts give no rows."""
    block = F.regexp_extract(F.col(xml), r"(?s)<eigenvalues>(.*?)</eigenvalues>", 1)
    spins = df.select(key, F.posexplode(F.regexp_extract_all(block, F.lit(r'(?s)<set comment="spin ?\d+">(.*?)(?=<set comment="spin|$)'), 1)).alias("spin", "s"))
    points = spins.select(key, (F.col("spin") + 1).alias("spin"), F.posexplode(F.regexp_extract_all("s", F.lit(r'(?s)<set comment="kpoint ?\d+">(.*?)</set>'), 1)).alias("k", "t"))
    rows = points.select(key, "spin", (F.col("k") + 1).alias("k"), F.posexplode(F.regexp_extract_all("t", F.lit(r"<r>\s*(.*?)\s*</r>"), 1)).alias("band", "r"))
    part = F.split("r", r"\s+")
    return rows.select(key, "spin", "k", (F.col("band") + 1).alias("band"), part[0].try_cast("double").alias("energy"), F.try_element_at(part, F.lit(2)).try_cast("double").alias("occupation"))


def in_window(df: DataFrame, energy: str, centre: Column, width: float) -> DataFrame:
    """Rows whose energy lies within the width of the centre, ends included."""
    return df.where((F.col(energy) - centre).between(-width, width))


def nested_report(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, report): one JSON text a key with a list of records for each part, in the order of their columns; nulls are kept.

    Each part is a DataFrame with the key; keys of any part have a report, parts without rows an empty list.
    """
    keys = None
    for df in parts.values():
        one = df.select(key)
        keys = one if keys is None else keys.unionByName(one)
    out = keys.distinct()
    for name, df in parts.items():
        rest = [c for c in df.columns if c != key]
        listed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out.select(key, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("report"))

