"""Library JSON as landed by its API: items, libraries, pages of results; cookies; local files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.payloads import content_type
from ..functions.text import split_names
from ..operators.playlist import is_media

#: Members that are texts or objects are read as variants.
RAW = (
    "struct<id:string,libraryId:string,path:string,relPath:string,media:struct<tags:array<string>,numAudioFiles:int,audioFiles:array<variant>,"
    "metadata:struct<title:string,subtitle:string,description:string,asin:string,isbn:string,language:string,publishedYear:string,"
    "authorName:string,narratorName:string,seriesName:string,authors:array<variant>,narrators:array<variant>,series:array<variant>,genres:array<string>>>>"
)
PAGE_SIZE = 200


def _filled(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def _names(members: Column, joined: Column) -> Column:
    """Names of texts or objects with a name; where there is no list, the joined text split."""
    name = lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.when(members.isNotNull(), _filled(F.transform(members, name))).otherwise(split_names(joined))


def items(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Item JSON texts to flat rows."""
    row = raw.select(F.from_json(json_col, RAW).alias("r"))
    m = lambda name: F.col(f"r.media.metadata.{name}")
    empty = F.array().cast("array<string>")
    return row.select(
        F.col("r.id").alias("item_id"), F.col("r.libraryId").alias("library_id"), F.coalesce("r.path", F.lit("")).alias("path"), F.coalesce("r.relPath", F.lit("")).alias("rel_path"), F.coalesce(m("title"), F.lit("")).alias("title"),
        m("subtitle").alias("subtitle"), m("description").alias("description"), m("asin").alias("asin"), m("isbn").alias("isbn"), m("language").alias("language"), m("publishedYear").alias("published_year"),
        _names(m("authors"), m("authorName")).alias("authors"), _names(m("narrators"), m("narratorName")).alias("narrators"), _names(m("series"), m("seriesName")).alias("series"),
        F.coalesce(_filled(m("genres")), empty).alias("genres"), F.coalesce(_filled(F.col("r.media.tags")), empty).alias("tags"),
        F.coalesce(F.col("r.media.numAudioFiles"), F.when(F.col("r.media.audioFiles").isNotNull(), F.size("r.media.audioFiles"))).alias("num_audio_files"),
    )


def item(raw: DataFrame, item_id: str, json_col: str = "json") -> DataFrame:
    """The one item of that id among item JSON texts; only its text is parsed whole."""
    return items(raw.filter(F.get_json_object(json_col, "$.id") == item_id), json_col)


def result_pages(pages: DataFrame, size: int = PAGE_SIZE, last: int | None = None) -> DataFrame:
    """Item JSON texts of landed result pages (library, page, json), up to the first short page, however many there are; up to page ``last`` if that is given."""
    parsed = pages.select("library", "page", F.from_json("json", "struct<results:array<variant>>").alias("p")).withColumn("n", F.coalesce(F.size("p.results"), F.lit(0)))
    ends = parsed.filter(F.col("n") < size).groupBy("library").agg(F.min("page").alias("end"))
    upto = parsed if last is None else parsed.filter(F.col("page") <= last)
    kept = upto.join(ends, "library", "left").filter(F.col("end").isNull() | (F.col("page") <= F.col("end")))
    return kept.select("library", "page", F.explode("p.results").alias("v")).select("library", "page", F.to_json("v").alias("json"))


def book_libraries(raw: DataFrame, only: list[str] | None = None, json_col: str = "json") -> DataFrame:
    """(id, name) of the book libraries in a landed response, all or those named."""
    found = raw.select(F.explode(F.from_json(json_col, "struct<libraries:array<struct<id:string,name:string,mediaType:string>>>")["libraries"]).alias("l")).select("l.*").filter("mediaType = 'book'")
    return (found.filter(F.col("id").isin(*only)) if only else found).select("id", "name")


def cookies(meta: DataFrame, wanted: Column | str = "cookies") -> DataFrame:
    """(key, pos, name, value, domain, path, expires): cookies that meta rows hold as JSON; none where it is malformed.

    ``wanted`` is the row's key, or a condition on the rows.
    """
    kind = "array<struct<name:string,value:string,domain:string,path:string,expires:double>>"
    rows = meta.filter(F.col("key") == wanted if isinstance(wanted, str) else wanted)
    parsed = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", kind))
    return rows.select("key", F.posexplode(parsed).alias("pos", "c")).select("key", "pos", "c.*")


def set_cookies(responses: DataFrame) -> DataFrame:
    """Cookies that responses (line, host, at_s) set: name, value, expires in seconds and domain, with the other columns.

    Lines without a name set none. Of Expires and Max-Age the later attribute counts; a date that can't be read doesn't.
    Without a Domain the cookie is the host's.
    """
    parts = F.split("line", ";")
    pair = F.element_at(parts, 1)
    attrs = F.transform(F.slice(parts, 2, 1000), lambda a: F.struct(F.lower(F.trim(F.substring_index(a, "=", 1))).alias("k"), F.when(F.instr(a, "=") > 0, F.trim(F.element_at(F.split(a, "="), 2))).alias("v")))
    date = lambda v: F.unix_timestamp(F.try_to_timestamp(F.replace(F.regexp_replace(v, r"^[A-Za-z]+,\s*|\s*(?:GMT|UTC)$", ""), F.lit("-"), F.lit(" ")), F.lit("d MMM yyyy HH:mm:ss")))
    told = lambda a: F.when(a["k"] == "expires", date(a["v"])).when(a["k"] == "max-age", F.col("at_s") + F.regexp_extract(a["v"], "^([+-]?[0-9]{1,12})", 1).try_cast("long"))
    last = lambda values: F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))
    own = F.nullif(last(F.transform(attrs, lambda a: F.when(a["k"] == "domain", a["v"]))), F.lit(""))
    named = responses.filter(F.instr(pair, "=") > 1)
    return named.select(*responses.columns, F.trim(F.substring_index(pair, "=", 1)).alias("name"), F.trim(F.substr(pair, F.instr(pair, "=") + 1)).alias("value"), last(F.transform(attrs, told)).alias("expires"), F.coalesce(own, "host").alias("domain"))


def cookie_header(rows: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, header): one Cookie header of each jar; by name the last cookie counts."""
    last = rows.groupBy(*by, "name").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), "; ").alias("header"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, dir, file, length) of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("dir", F.regexp_replace("path", "/[^/]+$", ""))


def folders_with_media(found: DataFrame) -> DataFrame:
    return found.filter(is_media(F.col("file"))).select("dir").distinct()


def best_cover(found: DataFrame, least_bytes: int = 64) -> DataFrame:
    """(dir, path): the first cover by extension that isn't tiny."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("jpg", "jpeg", "png", "webp")]), F.lower(F.regexp_extract("file", r"^cover\.([^.]+)$", 1)))
    return found.withColumn("rank", rank).filter((F.col("rank") > 0) & (F.col("length") >= least_bytes)).groupBy("dir").agg(F.min_by("path", "rank").alias("path"))


def listing(found: DataFrame) -> DataFrame:
    """Files of each folder with their place in the order in which people read names: letters before case."""
    order = Window.partitionBy("dir").orderBy(F.collate("file", "UNICODE"), "file")
    return found.withColumn("place", F.row_number().over(order))


def image_kind(content: Column) -> Column:
    """jpeg, png or webp by the first bytes; null for anything else."""
    return F.regexp_extract(content_type(content), "([a-z]+)$", 1)


def sniffed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, dir, file, length, kind) of the files below a folder, by what they hold and not by what they are called."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.regexp_replace("path", "/[^/]+$", "").alias("dir"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", image_kind(F.col("content")).alias("kind"))


def placement_plan(staged: DataFrame, present: DataFrame, mode: str = "all") -> DataFrame:
    """What placing staged files (file, length, hash) into a folder does: skipped, copied or linked."""
    there = present.select("file", F.col("length").alias("old_length"), F.col("hash").alias("old_hash"))
    same = (F.col("length") == F.col("old_length")) & (F.col("hash") == F.col("old_hash"))
    media = is_media(F.col("file"))
    action = F.when(F.col("file").startswith("."), "skipped").when(media & F.lit(mode == "metadata-only"), "skipped").when(F.coalesce(same, F.lit(False)), "skipped").when(media, "linked").otherwise("copied")
    return staged.join(there, "file", "left").select("file", action.alias("action"))


def write_files(rows: DataFrame) -> None:
    """Write (path, content) rows as files, each moved to its name when it is whole; a retried task writes the same again.

    Paths are absolute or URIs of a file system that all executors reach.
    """

    def write(part) -> None:
        from pyarrow import fs

        for row in part:
            system, path = fs.FileSystem.from_uri(row["path"])
            folder, _, name = path.rpartition("/")
            system.create_dir(folder, recursive=True)
            partial = f"{folder}/.tmp-{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(partial) as out:
                out.write(bytes(row["content"]))
            system.move(partial, path)

    rows.select("path", F.col("content").cast("binary").alias("content")).foreachPartition(write)
