"""Files in and out: dumps, change feeds, package lists, reports, exports, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.encodings import sha1_from_base36
from lorekeep.functions.langs import pure_title, tag_of_language, title_language
from lorekeep.functions.times import parse_timestamp, round_to_second
from lorekeep.operators.graph import place_in_group
from lorekeep.session import ensure_checkpoint_dir
from lorekeep.sources.catalog import Catalog
from lorekeep.sources.schemas import SCHEMAS


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared checkpoint folder, which every executor reaches."""
    return f"{ensure_checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


# ---- snapshots ----------------------------------------------------------------------------


def write_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """Write tables as a new snapshot; readers switch to it by its path."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")


def write_partitioned(df: DataFrame, path: str, timestamp: str) -> None:
    """Store an event table by month, sorted by time inside the files."""
    month = F.date_format(timestamp, "yyyy-MM")
    keyed = df.withColumn("ym", month).repartitionByRange("ym", timestamp).sortWithinPartitions(timestamp)
    keyed.write.mode("overwrite").partitionBy("ym").parquet(path)


def _element(name: str, value: Column) -> Column:
    """An XML element, or nothing for NULL."""
    safe = value.cast("string")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(mark), F.lit(entity))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name}>")), F.lit(""))


def _page_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``page, head, revision`` as lines: a head where a page begins in this file, its end where it ends."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        page, head, revision = batch.columns
        before = pa.concat_arrays([pa.array([last], page.type), page[:-1]])
        begins = pc.fill_null(pc.not_equal(page, before), True)
        ends = pc.if_else(pc.is_valid(before), "</page>", "")
        marks = pc.if_else(begins, pc.binary_join_element_wise(ends, head, ""), "")
        last = page[-1].as_py()
        yield pa.record_batch([pc.binary_join_element_wise(marks, revision, "")], ["value"])
    if last is not None:
        yield pa.record_batch([pa.array(["</page>"])], ["value"])


def write_dump(rows: DataFrame, path: str) -> None:
    """Revisions (columns of ``revision`` plus page, ``sha1`` in base 36 and text) as a page history dump.

    A revision is a row, dealt by page and id, so no page is gathered. A page that is longer than a file goes
    on in the next one under its head again; its revisions are in order of their ids throughout.
    """
    user = F.concat(_element("username", F.col("rev_user_text")), _element("id", F.col("rev_user")))
    revision = F.concat(
        F.lit("<revision>"), _element("id", F.col("rev_id")), _element("parentid", F.col("rev_parent_id")),
        _element("timestamp", F.date_format("rev_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("<contributor>"), user,
        F.lit("</contributor>"), F.when(F.col("rev_minor_edit"), F.lit("<minor/>")).otherwise(F.lit("")),
        _element("comment", F.col("rev_comment")), _element("model", F.col("rev_content_model")),
        _element("format", F.col("rev_content_format")), _element("text", F.coalesce("old_text", F.lit(""))),
        _element("sha1", F.col("sha1")), F.lit("</revision>"),
    )
    head = F.concat(
        F.lit("<page>"), _element("title", F.col("page_title")), _element("ns", F.col("page_namespace")), _element("id", F.col("rev_page"))
    )
    ordered = rows.where("rev_page is not null").repartitionByRange("rev_page", "rev_id").sortWithinPartitions("rev_page", "rev_id")
    marked = ordered.select(F.col("rev_page").cast("long").alias("page"), head.alias("head"), revision.alias("revision"))
    marked.mapInArrow(_page_marks, "value string").write.text(path)


# ---- sources ------------------------------------------------------------------------------

_PAGE_HEAD = "title string, ns int, id long"
_REVISION = """
    id long, parentid long, timestamp string, contributor struct<username: string, id: long, ip: string>,
    minor string, comment string, model string, format string, sha1 string, text struct<_VALUE: string, _bytes: long>
"""


def _dump_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text up to the end of each revision, with the split it lies in and the head of a page if one begins.

    Marks never stand in contents, where they are escaped. A split starts with the first piece that
    begins in it, so pieces of a file are ordered by split and, within one, as they are read.
    """
    pieces = spark.read.option("lineSep", "</revision>").text(path)
    begins = F.contains("value", F.lit("<page>"))
    head = F.concat(F.lit("<page>"), F.substring_index(F.substring_index("value", "<page>", -1), "<revision>", 1), F.lit("</page>"))
    return pieces.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.when(begins, head).alias("head"), "value",
    )


def _last_heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last head of each split in a batch, NULL where no page begins, and the number of the batch."""
    for number, batch in enumerate(batches):
        last = pa.table(batch).group_by(["file", "split"], use_threads=False).aggregate([("head", "last")])
        columns = [last["file"], last["split"], last["head_last"], pa.array([number] * last.num_rows, pa.int64())]
        yield from pa.table(columns, names=["file", "split", "head", "number"]).to_batches()


def _carry_page(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``page`` filled forward within each split; texts pass through untouched."""
    place, page = (None, None), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, split, own = batch.column("file"), batch.column("split"), batch.column("page")
        changes = np.zeros(n, bool)
        for column, last in zip((file, split), place, strict=True):
            before = pa.concat_arrays([pa.array([last], column.type), column[:-1]])
            changes |= pc.fill_null(pc.not_equal(column, before), True).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(changes, at, -1))
        head = np.maximum.accumulate(np.where(own.is_valid().to_numpy(zero_copy_only=False), at, -1))
        # row n is the page of the batch before
        wanted = np.where((head >= 0) & (head >= start), head, n)
        none = (wanted == n) & (start >= 0)
        known = pa.concat_arrays([own, pa.nulls(1, own.type) if page is None else page])
        filled = known.take(pa.array(wanted, mask=none))
        place, page = (file[-1].as_py(), split[-1].as_py()), filled[-1:]
        yield batch.set_column(2, batch.schema.field("page"), filled)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Page history dump: one row per revision in the columns of ``revision`` plus page and text.

    Dumps are cut at revisions, not at pages, so a page of any length is many rows and tasks. The
    head of a page is carried forward to its revisions: within a split by the task that reads it,
    and into the following splits by a table of one row per split.
    """
    pieces = _dump_pieces(spark, path)
    # one row per split and batch; only the heads that others inherit are parsed here
    heads = pieces.select("file", "split", "head").mapInArrow(_last_heads, "file string, split long, head string, number long")
    lasts = heads.groupBy("file", "split").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("number"))).alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inherited = lasts.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("head"))
    inherited = inherited.select("file", "split", F.from_xml("head", _PAGE_HEAD).alias("inherited"))
    # written, so that Spark knows its size and does not shuffle texts to it while it is small
    stored = scratch_folder(spark, "splits")
    inherited.write.parquet(stored)
    inherited = spark.read.schema(inherited.schema).parquet(stored)
    pieces = pieces.select("file", "split", F.when(F.col("head").isNotNull(), F.from_xml("head", _PAGE_HEAD)).alias("page"), "value")
    rows = pieces.mapInArrow(_carry_page, pieces.schema).join(inherited, ["file", "split"], "left")
    begins = F.instr("value", "<revision>")
    revision = F.from_xml(F.concat(F.expr("substring(value, instr(value, '<revision>'))"), F.lit("</revision>")), _REVISION, {"ignoreSurroundingSpaces": "false"})
    page = F.coalesce("page", "inherited")
    rows = rows.where(begins > 0).select(page.alias("page"), revision.alias("r")).select(
        F.col("page.id").alias("rev_page"), F.col("page.ns").alias("page_namespace"), F.col("page.title").alias("page_title"), "r"
    )
    text = F.coalesce("r.text._VALUE", F.lit(""))
    return rows.select(
        F.col("r.id").alias("rev_id"), "rev_page", "page_namespace", "page_title",
        F.coalesce("r.comment", F.lit("")).alias("rev_comment"),
        F.coalesce("r.contributor.id", F.lit(0)).alias("rev_user"),
        F.coalesce("r.contributor.username", "r.contributor.ip").alias("rev_user_text"),
        parse_timestamp(F.col("r.timestamp")).alias("rev_timestamp"), F.col("r.minor").isNotNull().alias("rev_minor_edit"),
        F.octet_length(text).cast("long").alias("rev_len"), F.col("r.parentid").alias("rev_parent_id"),
        sha1_from_base36("r.sha1").alias("rev_sha1"), F.col("r.model").alias("rev_content_model"),
        F.col("r.format").alias("rev_content_format"), text.alias("old_text"),
    )


def read_feed(spark: SparkSession, path: str, table: str, since: str | None = None, time_column: str | None = None) -> DataFrame:
    """Landed change feed as JSON lines with the declared schema of ``table``."""
    df = normalize_feed(spark.read.schema(SCHEMAS[table]).json(path), table)
    if since is not None:
        df = df.where(F.col(time_column) >= F.lit(since).cast("timestamp_ntz"))
    return df


def normalize_feed(df: DataFrame, table: str) -> DataFrame:
    """Timestamps to whole seconds, half up, as the tables store them."""
    out = {f.name: round_to_second(F.col(f.name)) for f in SCHEMAS[table].fields if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(out)


_SITE = """
    namespaces array<struct<id: int, `case`: string, `*`: string, canonical: string, content: string,
                            subpages: string, nonincludable: string>>,
    namespacealiases array<struct<id: int, `*`: string>>,
    interwikimap array<struct<prefix: string, url: string, api: string, local: string, trans: string>>,
    tags array<struct<name: string, displayname: string, description: string, defined: string, active: string,
                      source: array<string>>>
"""


def read_site(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Site snapshot: namespaces, names, interwiki prefixes and tags. A flag is set when its key is there.

    Files hold one document each, or one per line with ``lines``.
    """
    site = spark.read.schema(_SITE).option("multiLine", not lines).json(path)

    def rows(field: str) -> DataFrame:
        return site.select(F.explode(field).alias("x"))

    flag = lambda name: F.col("x." + name).isNotNull()
    spaces = rows("namespaces")
    star = spaces.select(F.col("x")["id"].alias("nss_id"), F.col("x")["*"].alias("nss_name"))
    canonical = spaces.where("x.canonical is not null").select(
        F.col("x.id").alias("nsc_id"), F.col("x.canonical").alias("nsc_name")
    )
    aliases = rows("namespacealiases").select(F.col("x")["id"].alias("id"), F.col("x")["*"].alias("name"))
    names = star.toDF("nsn_id", "nsn_name").union(canonical).union(aliases).distinct()
    return {
        "namespace": spaces.select(
            F.col("x.id").alias("ns_id"), F.col("x.case").alias("ns_case"), flag("content").alias("ns_content"),
            flag("subpages").alias("ns_subpages"), flag("nonincludable").alias("ns_nonincludable"),
        ),
        "namespace_starname": star, "namespace_canonical": canonical, "namespace_name": names,
        "interwiki": rows("interwikimap").select(
            F.col("x.prefix").alias("iw_prefix"), F.col("x.url").alias("iw_url"), F.col("x.api").alias("iw_api"),
            flag("local").alias("iw_local"), flag("trans").alias("iw_trans"),
        ),
        "tag": rows("tags").select(
            F.col("x.name").alias("tag_name"), F.coalesce("x.displayname", F.lit("(hidden)")).alias("tag_displayname"),
            F.nullif(F.col("x.description"), F.lit("")).alias("tag_description"), flag("defined").alias("tag_defined"),
            flag("active").alias("tag_active"), F.col("x.source").alias("tag_source"),
        ),
    }


def read_package_list(spark: SparkSession, path: str) -> DataFrame:
    """Line-oriented package list (plain or gzip)."""
    return package_lines(spark.read.text(path))


def package_lines(lines: DataFrame) -> DataFrame:
    """Names without blank lines and ``#`` comments."""
    name = F.trim("value")
    return lines.select(name.alias("name")).where((F.col("name") != "") & ~F.startswith("name", F.lit("#")))


def read_recovered(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON lists of recovered revisions (or one per line), in the columns of ``revision``."""
    return spark.read.schema(SCHEMAS["revision"]).option("multiLine", not lines).json(path)


# ---- wiki tables --------------------------------------------------------------------------


def wiki_table_rows(df: DataFrame, columns: list[str], single_line: bool = True) -> Column:
    """Markup of one table row."""
    cells = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in columns]
    if single_line:
        return F.concat(F.lit("|-\n| "), F.concat_ws(" || ", *cells))
    return F.concat(F.lit("|-\n"), F.concat_ws("\n", *[F.concat(F.lit("| "), x) for x in cells]))


def wiki_table(df: DataFrame, columns: list[str], order: list[Column], single_line: bool = True) -> DataFrame:
    """Lines of a wiki table, ``place, value``: header, rows in order, footer.

    The rows keep their place through a distributed numbering, so the table may be
    of any length; write it with ``write_lines``.
    """
    header = '{| class="wikitable sortable" border=1\n' + "\n".join("! " + x for x in columns)
    rows = place_in_group(df.withColumn("_all", F.lit(1)), "_all", order, "place")
    body = rows.select("place", wiki_table_rows(rows, columns, single_line).alias("value"))
    ends = df.sparkSession.createDataFrame([(0, header), (2**62, "|}")], "place long, value string")
    return body.unionByName(ends)


def write_lines(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Write ``place, value`` rows as text files whose names sort in the order of the places."""
    parts = lines.repartitionByRange(files, "place") if files else lines.repartitionByRange("place")
    parts.sortWithinPartitions("place").select("value").write.mode("errorifexists").text(path)


_CELL = r"(?m)^\|(?![-}])(.*?)$"


def _cells(markup: Column) -> Column:
    """Cells of one row's markup, with one row per line or one cell per line."""
    lines = F.regexp_extract_all(markup, F.lit(_CELL), F.lit(1))
    return F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, r"\|\|"))), lambda x: F.trim(x))


def parse_wiki_tables(df: DataFrame, text: str) -> DataFrame:
    """Rows of the tables written by :func:`wiki_table`: the other columns, ``row`` and ``cells``."""
    rest = [x for x in df.columns if x != text]
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)\{\|.*?(\|-.*?)\n?\|\}", 1), r"^\|-", "")
    rows = df.select(*rest, F.posexplode(F.split(body, r"\n\|-")).alias("row", "markup"))
    return rows.select(*rest, "row", _cells(F.col("markup")).alias("cells")).where(F.size("cells") > 0)


def read_wiki_table(spark: SparkSession, path: str) -> DataFrame:
    """One table, a file or a folder of files as :func:`write_lines` makes it: ``fields, row, cells``.

    Read row by row: the row mark separates records, so neither a file nor a table is
    ever held whole. Rows are numbered from 0 in the order of file names and positions.
    """
    records = spark.read.option("lineSep", "\n|-\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    opens = F.startswith(F.ltrim("value"), F.lit("{|"))
    first = records.where(opens).select(
        F.regexp_extract_all("value", F.lit(r"(?m)^!\s*(.*?)$"), F.lit(1)).alias("fields")
    )
    rows = records.where(~opens).withColumn("cells", _cells(F.col("value")))
    rows = rows.where(F.size("cells") > 0).select("_file", "_start", "_id", "cells", F.lit(1).alias("_all"))
    numbered = place_in_group(rows, "_all", [F.col("_file"), F.col("_start"), F.col("_id")], "_place")
    fields = first.agg(F.first("fields").alias("fields")).scalar()
    return numbered.select(fields.alias("fields"), (F.col("_place") - 1).alias("row"), "cells")


# ---- reports and exports ------------------------------------------------------------------


def report_lines(messages: DataFrame) -> DataFrame:
    """Grouped report from ``title, message``: ``language, title, line`` in reading order.

    Each page has one heading line and one line per message; nothing is collected
    per language, the order comes from a distributed sort.
    """
    base = messages.select(title_language(F.col("title")).alias("language"), "title", "message")
    heads = base.select("language", "title").distinct().select(
        "language", "title", F.lit("").alias("message"), F.concat(F.lit("* [["), "title", F.lit("]]")).alias("line")
    )
    rows = base.select("language", "title", "message", F.concat(F.lit("** "), "message").alias("line"))
    return heads.unionByName(rows).orderBy("language", "title", "message").select("language", "title", "line")


def write_report(messages: DataFrame, path: str) -> None:
    """Report as JSON and as wikitext, one folder per language."""
    report_lines(messages).write.partitionBy("language").mode("errorifexists").json(path + "/json")
    lines = report_lines(messages).select("language", F.col("line").alias("value"))
    lines.write.partitionBy("language").mode("errorifexists").text(path + "/text")


# fixed values: namespaces whose pages are exported per language
_LOCALIZED_SPACES = [
    "Talk", "Project", "Project_talk", "Template", "Template_talk", "Help", "Help_talk", "Category", "Category_talk",
]


def export_path(namespace: Column, title: Column, extension: str = "wiki", ascii_only: bool = False, spaces: list[str] | None = None) -> Column:
    """Relative file of a page: by language, with the namespace in the name."""
    spaces = _LOCALIZED_SPACES if spaces is None else spaces
    ns = F.replace(F.coalesce(namespace, F.lit("")), F.lit(" "), F.lit("_"))
    name = F.replace(pure_title(title), F.lit(" "), F.lit("_"))
    if ascii_only:
        name = F.when(name.rlike(r"^\p{ASCII}*$"), name).otherwise(F.md5(name))
    lang = F.concat(tag_of_language(title_language(title)), F.lit("/"))
    end = F.lit("." + extension)
    return (
        F.when(ns == "", F.concat(lang, name, end))
        .when(ns.isin(spaces), F.concat(lang, ns, F.lit(":"), name, end))
        .when(ns == "File", F.concat(ns, F.lit(":"), name))
        .otherwise(F.concat(ns, F.lit(":"), name, end))
    )


def exported_pages(cat: Catalog, pages: DataFrame, **options) -> DataFrame:
    """``page_id, path, touched`` of pages that are no redirects."""
    names = cat["namespace_starname"]
    df = pages.where("not page_is_redirect").join(names, F.col("page_namespace") == F.col("nss_id"), "left")
    return df.select(
        "page_id", export_path(F.col("nss_name"), F.col("page_title"), **options).alias("path"),
        F.col("page_touched").alias("touched"),
    )


def export_changes(exported: DataFrame, manifest: DataFrame, epoch: str | None = None) -> DataFrame:
    """What to do with each file: ``path, action`` (``write`` or ``delete``).

    ``manifest`` has ``path, written``. Files older than the page or than ``epoch``
    are written again; files without a page are deleted. One full outer join.
    """
    df = exported.select("path", "touched").join(manifest.select("path", "written"), "path", "full_outer")
    old = F.col("written").isNull() | (F.col("written") < F.col("touched"))
    if epoch is not None:
        old = old | (F.col("written") < F.lit(epoch).cast("timestamp_ntz"))
    action = F.when(F.col("touched").isNull(), F.lit("delete")).when(old, F.lit("write"))
    return df.select("path", action.alias("action")).where("action is not null")


def write_export(pages: DataFrame, path: str) -> None:
    """Write page texts (``path, body``) partitioned by language."""
    keyed = pages.withColumn("lang", F.regexp_extract("path", "^([^/]+)/", 1))
    keyed.write.partitionBy("lang").mode("errorifexists").parquet(path)
