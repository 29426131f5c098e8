"""Format rules of result files, as a table of violations.

Lines are read as text, not as CSV, so that malformed rows stay visible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.durable import durable


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, s1_id, ids, has_tab) of raw lines (line): ids is the untrimmed list, empty for an empty field."""
    cut = lines.select("line", F.instr("line", "\t").alias("at"))
    tail = F.expr("substring(line, at + 1)")
    ids = F.when((F.col("at") == 0) | (F.trim(tail) == ""), F.array().cast("array<string>")).otherwise(F.split(tail, ","))
    return cut.select("line", F.when(F.col("at") > 0, F.trim(F.expr("substring(line, 1, at - 1)"))).alias("s1_id"), ids.alias("ids"), (F.col("at") > 0).alias("has_tab"))


def violations(lines: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, s1_id, detail) for data lines (line) against the required reference ids (id) and, if given, all candidate ids (id).

    Lines are parsed once and written; rules of one line come from one pass.
    """
    rows = durable(parse_lines(lines.where(F.trim("line") != "")), "validator-lines")
    found = lambda rule, s1, detail: F.struct(F.lit(rule).alias("rule"), s1.cast("string").alias("s1_id"), detail.cast("string").alias("detail"))
    none, s1 = F.lit(None), F.col("s1_id")
    of_ids = lambda rule, bad: F.transform(F.filter("ids", bad), lambda x: found(rule, s1, x))
    of_line = F.when(F.col("has_tab"), F.concat(of_ids("self_source_id", lambda x: x.startswith("S1-")), of_ids("bad_prefix", lambda x: ~x.rlike("^S[123]-")))).otherwise(F.array(found("no_tab", none, F.col("line"))))
    good = rows.where("has_tab")
    each = good.select("s1_id", F.explode("ids").alias("id"))
    several = F.col("n") > 1
    parts = [
        rows.select(F.explode(of_line).alias("v")),
        good.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).where(several).select(found("duplicate_row", s1, F.col("n")).alias("v")),
        each.groupBy("s1_id", "id").agg(F.count(F.lit(1)).alias("n")).where(several).select(found("repeated_id", s1, F.col("id")).alias("v")),
        required.select("id").distinct().join(good.select(s1.alias("id")), "id", "left_anti").select(found("missing_s1", F.col("id"), none).alias("v")),
        good.select(s1.alias("id")).distinct().join(required.select("id"), "id", "left_anti").select(found("foreign_s1", F.col("id"), none).alias("v")),
    ]
    if known is not None:
        listed = each.where(F.col("id").rlike("^S[23]-"))
        parts.append(listed.join(known.select("id").distinct(), "id", "left_anti").select(found("unknown_id", s1, F.col("id")).alias("v")))
    return reduce(DataFrame.unionByName, parts).select("v.*")


def not_in_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reference ids with a match (s1_id, cand_id) that is not among their candidates: a warning, not an error."""
    return matches.join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").select("s1_id").distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def validate(spark: SparkSession, path: str, required: DataFrame, column: str = "matched_entity_ids", known: DataFrame | None = None) -> tuple[list[str], DataFrame | None]:
    """Fatal problems of a result file, or of a folder of parts with a header each, and the table of its violations if there are none.

    A header line that a file repeats is a violation too.
    """
    if not _exists(spark, path):
        return ["file not found"], None
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    head = lines.limit(1).collect()
    if not head:
        return ["empty file"], None
    if not lines.where(~F.is_valid_utf8("line")).isEmpty():
        return ["not UTF-8"], None
    header = head[0]["line"]
    if "\t" not in header:
        return ["comma separated" if "," in header else "header has no tab"], None
    if [c.strip().lower() for c in header.split("\t")] != ["source1_entity_id", column]:
        return [f"header is {header!r}"], None
    is_header = F.col("line") == header
    per_file = lines.groupBy("file").agg(F.count_if(is_header).alias("n"))
    if not per_file.where("n = 0").isEmpty():
        return ["a part has no header"], None
    repeated = per_file.where("n > 1").select(F.lit("repeated_header").alias("rule"), F.lit(None).cast("string").alias("s1_id"), (F.col("n") - 1).cast("string").alias("detail"))
    return [], violations(lines.where(~is_header).select("line"), required, known).unionByName(repeated)


def validate_results(spark: SparkSession, matching: str, candidates: str | None, required: DataFrame, known: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) about a matching file and, if it is there, a candidate file."""
    errors, warnings = [], [] if known is not None else ["ids are not checked for existence"]

    def check(path: str, column: str) -> DataFrame | None:
        fatal, table = validate(spark, path, required, column, known)
        errors.extend(f"{path}: {x}" for x in fatal)
        if table is None:
            return None
        for r in table.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("s1_id").alias("first")).orderBy("rule").collect():
            errors.append(f"{path}: {r.rule} {r.n} times, as for {r['first']}")
        parsed = parse_lines(spark.read.text(path).select(F.col("value").alias("line"))).where("has_tab and s1_id <> 'source1_entity_id'")
        return parsed.select("s1_id", F.explode(F.transform("ids", lambda x: F.trim(x))).alias("cand_id"))

    matched = check(matching, "matched_entity_ids")
    if candidates and not _exists(spark, candidates):
        warnings.append(f"{candidates}: not found, its checks are skipped")
    elif candidates:
        listed = check(candidates, "candidate_entity_ids")
        if matched is not None and listed is not None and (n := not_in_candidates(matched, listed).count()):
            warnings.append(f"{n} reference records have matches that are not among their candidates")
    return errors, warnings
