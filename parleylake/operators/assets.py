"""Media references against listed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parleylake.functions.names import path_key
from parleylake.functions.urls import file_name, file_stem, thumbnail_name


def listed(files: DataFrame) -> DataFrame:
    """Present files as (path, name_key, path_key)."""
    f = files.where(~F.coalesce(F.col("is_deleted"), F.lit(False)) & F.col("path").isNotNull())
    return f.select("path", F.lower(file_name(F.col("path"))).alias("name_key"), path_key(F.col("path")).alias("path_key")).distinct()


def references(matches: DataFrame) -> DataFrame:
    """The distinct references of asset matches as (match_id, pos, reference)."""
    return matches.select("match_id", F.posexplode("candidate_paths").alias("pos", "reference")).where("trim(reference) <> ''").distinct()


def basename_matches(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References and files of the same name, or the name of its thumbnail: reference, name, path, ambiguous.

    A name that several files have is ambiguous.
    """
    wanted = refs.select("reference", file_name(F.col("reference")).alias("n")).where("n <> ''").select("reference", F.explode(F.array(F.lower("n"), F.lower(thumbnail_name(F.col("n"))))).alias("name_key")).distinct()
    hit = wanted.join(listed(files).select("path", "name_key"), "name_key")
    many = listed(files).groupBy("name_key").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return hit.join(many, "name_key").select("reference", F.col("name_key").alias("name"), "path", "ambiguous")


def basename_summary(refs: DataFrame, files: DataFrame) -> DataFrame:
    """How many names were wanted, hit, hit once and several times, and how many references that maps."""
    wanted = refs.select(file_name(F.col("reference")).alias("n")).where("n <> ''").select(F.explode(F.array(F.lower("n"), F.lower(thumbnail_name(F.col("n"))))).alias("name"))
    hit = basename_matches(refs, files)
    names = hit.groupBy("name").agg(F.max("ambiguous").alias("a"))
    a, b, c = wanted.agg(F.count_distinct("name").alias("wanted_names")), names.agg(F.count(F.lit(1)).alias("hit_names"), F.count_if(~F.col("a")).alias("unique_hit_names"), F.count_if("a").alias("ambiguous_hit_names")), hit.where("not ambiguous").agg(F.count_distinct("reference").alias("mapped_references"))
    # one row each
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def rule_hits(refs: DataFrame, files: DataFrame, *, most_examples: int = 10) -> DataFrame:
    """Per naming rule how many references it explains first, with its first ten references as examples.

    The rules are tried in order: the exact name, its thumbnail, both in lower case. File names compare without regard
    to case, so the last two only come into play for names that are not ASCII.
    """
    n = file_name(F.col("reference"))
    rules = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("rule"), v.alias("name")) for i, (r, v) in enumerate([("basename_exact", n), ("basename_tmb", thumbnail_name(n)), ("basename_lower_exact", F.lower(n)), ("basename_lower_tmb", F.lower(thumbnail_name(n)))])])
    tried = refs.select("reference").distinct().where(n != "").select("reference", F.explode(rules).alias("r")).select("reference", "r.i", "r.rule", F.lower("r.name").alias("name_key"))
    names = listed(files).groupBy("name_key").agg(F.min("path").alias("path"))
    first = tried.join(names, "name_key").groupBy("reference").agg(F.min(F.struct("i", "rule", "path")).alias("s"))
    hit = first.select(F.col("s.rule").alias("rule"), "reference")
    # limited within each task before anything is shuffled
    few = hit.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("reference"))).where(F.col("k") <= most_examples)
    shown = few.groupBy("rule").agg(F.array_sort(F.collect_list("reference")).alias("examples"))
    return hit.groupBy("rule").agg(F.count(F.lit(1)).alias("references")).join(shown, "rule")


def digest_hits(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Present files whose name's stem is a digest that a reference has: (stem, path)."""
    wanted = refs.select(F.lower(file_stem(file_name(F.col("reference")))).alias("stem")).where(F.col("stem").rlike("^(?:[0-9a-f]{16}|[0-9a-f]{32})$")).distinct()
    have = listed(files).select(F.lower(file_stem(F.col("name_key"))).alias("stem"), "path")
    return have.join(wanted, "stem", "left_semi")


def wanted_digests(refs: DataFrame) -> DataFrame:
    """The digests that references to received pictures name (column md5): stems of 32 hex digits below the scheme's C2C folder."""
    tail = F.lower(file_stem(file_name(F.col("reference"))))
    return refs.where(F.col("reference").rlike(r"(?i)^UserDataImage:C2C[\\/]")).select(tail.alias("md5")).where(F.col("md5").rlike("^[0-9a-f]{32}$")).distinct()


def content_digests(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files (path, content) whose MD5 is among the wanted ones (column md5)."""
    return files.select("path", F.md5("content").alias("md5")).join(wanted.select(F.lower("md5").alias("md5")).distinct(), "md5", "left_semi")


def first_present(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Per match the first of its references that is a present file, in the order they are written: (match_id, path, pos)."""
    have = listed(files).groupBy("path_key").agg(F.min("path").alias("path"))
    return refs.withColumn("path_key", path_key(F.col("reference"))).join(have, "path_key").groupBy("match_id").agg(F.min(F.struct("pos", "path")).alias("s")).select("match_id", "s.path", "s.pos")


def unresolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Matches none of whose references is a present file, with the first non-empty reference."""
    have = listed(files).select("path_key").distinct().withColumn("here", F.lit(1))
    r = refs.withColumn("path_key", path_key(F.col("reference"))).join(have, "path_key", "left")
    return r.groupBy("match_id").agg(F.max(F.coalesce("here", F.lit(0))).alias("here"), F.min(F.struct("pos", "reference")).alias("s")).where("here = 0").select("match_id", F.col("s.reference").alias("reference"))


def contains_any(texts: DataFrame, needles: list[str], text: str = "text", most: int = 5000) -> DataFrame:
    """Texts with ``hits``: the needles they contain, without regard to case. The list of needles is bounded by ``most``."""
    if len(needles) > most:
        raise ValueError(f"there are more than {most} needles")
    wanted = F.array(*[F.lit(n.lower()) for n in sorted(set(needles))]).cast("array<string>")
    return texts.withColumn("hits", F.filter(wanted, lambda n: F.contains(F.lower(F.col(text)), n))).where(F.size("hits") > 0)


def link_report(links: DataFrame, files: DataFrame) -> DataFrame:
    """Counts of links (link, kind, path_key) by kind, and of local ones by whether their file is present."""
    j = links.join(listed(files).select("path_key", F.lit(True).alias("here")).distinct(), "path_key", "left")
    local = F.col("kind") == "local"
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(local).alias("local"), F.count_if(local & F.col("here").isNotNull()).alias("alive"), F.count_if(local & F.col("here").isNull()).alias("dead"), F.count_if(F.col("kind") == "external").alias("external"), F.count_if(F.col("kind") == "anchor").alias("anchor"))


def head_candidates(members: DataFrame, root: str) -> DataFrame:
    """Where the picture of a member may lie, likeliest first: (group_id, uin, candidates).

    Numbered faces have a large picture in several formats; null numbers have none.
    """
    # Folder and endings of numbered face pictures
    names = [f".large.{e}" for e in ("png", "jpg", "jpeg", "webp")] + [".large"]
    made = F.array(*[F.concat(F.lit(f"{root}/VasscUpdate/VasHead/face."), F.col("faceshop_face_id").cast("string"), F.lit(n)) for n in names])
    return members.where("group_id is not null and uin is not null").groupBy("group_id", "uin").agg(F.max(F.struct("read_at", "faceshop_face_id")).getField("faceshop_face_id").alias("faceshop_face_id")).select("group_id", "uin", F.when(F.col("faceshop_face_id").isNotNull(), made).otherwise(F.array().cast("array<string>")).alias("candidates"))
