"""File sources and sinks (inventory S1–S6, K2–K4, K7).

A folder of files is read as ``(path, content)`` rows; the file type is a
function of the path, so unwanted files are left out at listing.  ``path`` is
the key of a document all the way: files of one stem stay apart.  Items are
rows ``path, item_idx, type, text, title, keys, extra``, where ``keys`` is the
order of the item's JSON keys and ``extra`` its other values as they are.

Outputs are not one file per document (billions of tiny files would swamp any
distributed file system): each sink is one JSON-Lines dataset of ``path,
out_name, content``, written in parallel by every task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.patterns import (
    ADMITTED_EXTENSIONS,
    OFFICE_EXTENSIONS,
    PDF_EXTENSIONS,
    ROUTE_PROBE_ORDER,
    TEXT_EXTENSIONS,
)
from ..session import stored

OUTPUT_SCHEMA = "path string, out_name string, content string"
ITEM_KEYS = ("path", "item_idx")


# ---------------------------------------------------------------------------
# Manifest projections
# ---------------------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def split_ext(path: Column) -> Column:
    """Extension as ``os.path.splitext`` sees it (leading dots of the base
    name do not start an extension), lower-cased, without the dot."""
    stripped = F.regexp_replace(base_name(path), r"^\.+", "")
    return F.lower(F.when(F.instr(stripped, ".") > 0, F.substring_index(stripped, ".", -1)).otherwise(F.lit("")))


def route_ext(path: Column) -> Column:
    """S3: the extension, or — when there is none — the first known type
    whose name occurs anywhere in the lower-cased base name."""
    name = F.lower(base_name(path))
    probe = None
    for ext in ROUTE_PROBE_ORDER:
        probe = F.when(F.instr(name, ext) > 0, F.lit(ext)) if probe is None else probe.when(F.instr(name, ext) > 0, F.lit(ext))
    ext = split_ext(path)
    return F.when(ext != "", ext).otherwise(probe.otherwise(F.lit("")))


def route(path: Column) -> Column:
    """S3: ``pdf`` | ``office`` | ``text`` | ``unknown`` (unknown = office
    attempt, then an error in the original tool)."""
    e = route_ext(path)
    return (
        F.when(e.isin(*PDF_EXTENSIONS), F.lit("pdf"))
        .when(e.isin(*OFFICE_EXTENSIONS), F.lit("office"))
        .when(e.isin(*TEXT_EXTENSIONS), F.lit("text"))
        .otherwise(F.lit("unknown"))
    )


def route_files(manifest: DataFrame, path_col: str = "path") -> DataFrame:
    return manifest.withColumn("ext", route_ext(F.col(path_col))).withColumn("route", route(F.col(path_col)))


def admit_files(manifest: DataFrame, name_col: str = "name") -> DataFrame:
    """Upload admission: a dot is required; the text after the last dot,
    lower-cased, must be an admitted type."""
    n = F.col(name_col)
    ext = F.lower(F.substring_index(n, ".", -1))
    return manifest.withColumn("admitted", F.coalesce(F.instr(n, ".") > 0, F.lit(False)) & ext.isin(*ADMITTED_EXTENSIONS))


def stem(path: Column) -> Column:
    """``os.path.splitext(basename)[0]``: drop the last ``.xxx`` unless the
    only dots lead the name."""
    b = base_name(path)
    stripped = F.regexp_replace(b, r"^\.+", "")
    return F.when(F.instr(stripped, ".") > 0, F.regexp_replace(b, r"\.[^.]*$", "")).otherwise(b)


def output_names(manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """K2 + K7: output names per input, and the restore target derived from a
    masked Markdown name the two ways the original front ends did it (every
    occurrence of the marker is replaced, not only the suffix)."""
    s = stem(F.col(path_col))
    masked_md = F.concat(s, F.lit("_masked.md"))
    return manifest.select(
        "*",
        s.alias("stem"),
        masked_md.alias("masked_md"),
        F.concat(s, F.lit("_masked_content_list.json")).alias("masked_json"),
        F.concat(s, F.lit("_unmasked.md")).alias("unmasked_md"),
        F.concat(s, F.lit("_unmasked_content_list.json")).alias("unmasked_json"),
        F.concat(F.replace(masked_md, F.lit("_masked.md"), F.lit("")), F.lit("_unmasked.md")).alias("restore_md_web"),
        F.concat(
            F.when(F.regexp_replace(masked_md, r"\.md$", "").endswith("_masked"),
                   F.replace(F.regexp_replace(masked_md, r"\.md$", ""), F.lit("_masked"), F.lit("")))
            .otherwise(F.regexp_replace(masked_md, r"\.md$", "")),
            F.lit("_unmasked.md"),
        ).alias("restore_md_gui"),
    )


# ---------------------------------------------------------------------------
# readers
# ---------------------------------------------------------------------------

def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, content`` of every file under ``folder`` whose base name fits ``glob``.
    Spark lists no files of zero bytes, so an empty file gives no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "content")


def text_files(files: DataFrame) -> DataFrame:
    """The files of the text route."""
    return files.where(route(F.col("path")) == "text")


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the text-routed files of a folder.

    A text route needs one of the extensions somewhere in the base name (S3),
    so files without are not even opened.
    """
    any_case = ["".join(f"[{c}{c.upper()}]" for c in e) for e in TEXT_EXTENSIONS]
    return text_files(read_files(spark, folder, "*{" + ",".join(any_case) + "}*"))


def _decode_fallback(content: pd.Series) -> pd.DataFrame:
    def decode(b):
        if b is None:
            return None, None
        for enc in ("gbk", "gb2312"):
            try:
                return bytes(b).decode(enc), enc
            except UnicodeDecodeError:
                continue
        return bytes(b).decode("latin-1"), "latin-1"

    return pd.DataFrame([decode(b) for b in content], columns=["text", "encoding"])


def decode_bytes(files: DataFrame) -> DataFrame:
    """``path, text, encoding``: UTF-8 when the bytes are valid UTF-8 (in the
    JVM), else GBK, then GB2312, then Latin-1 (which never fails).  One pass;
    the Python step gets a null for every UTF-8 row.  Null content: no text."""
    as_str = F.col("content").cast("string")
    valid = F.is_valid_utf8(as_str)
    rest = F.pandas_udf(_decode_fallback, "text string, encoding string")(F.when(~valid, F.col("content")))
    rows = files.select("path", F.when(valid, as_str).alias("_utf8"), rest.alias("_rest"))
    return rows.select(
        "path", F.coalesce("_utf8", "_rest.text").alias("text"),
        F.when(F.col("_utf8").isNotNull(), F.lit("utf-8")).otherwise(F.col("_rest.encoding")).alias("encoding"),
    )


def scan_text_files(files: DataFrame) -> DataFrame:
    """Every file (``path, content``) is one text, wrapped as a one-item
    content list.  Line breaks become ``\\n`` (text mode); a final one stays."""
    return decode_bytes(files).where(F.col("text").isNotNull()).select(
        "path",
        F.lit(0).alias("item_idx"),
        F.lit("text").alias("type"),
        F.regexp_replace("text", r"\r\n?", "\n").alias("text"),
        F.lit(None).cast("string").alias("title"),
        F.array(F.lit("type"), F.lit("text")).alias("keys"),
        F.create_map(F.lit("type"), F.lit("text").cast("variant")).alias("extra"),
    )


def scan_content_list(lists: DataFrame) -> DataFrame:
    """Saved content lists (``path, content``: a JSON array of items) → item
    rows; the array position is the item order (never reader order).

    Every key of an item survives a write: ``extra`` holds all values but a
    ``text`` or ``title`` string.  Content that is no JSON array ends the job.
    """
    parsed = lists.select("path", F.from_json(F.col("content").cast("string"), "array<map<string,variant>>", {"mode": "FAILFAST"}).alias("_l"))
    items = parsed.select("path", F.posexplode_outer("_l").alias("item_idx", "it")).where(F.col("item_idx").isNotNull())

    def string(key: str) -> Column:
        v = F.element_at("it", F.lit(key))
        return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))

    items = items.select("path", "item_idx", "it", string("type").alias("type"), string("text").alias("text"), string("title").alias("title"))
    masked_away = lambda k: ((k == "text") & F.col("text").isNotNull()) | ((k == "title") & F.col("title").isNotNull())
    return items.select(
        "path", "item_idx", "type", "text", "title", F.map_keys("it").alias("keys"), F.map_filter("it", lambda k, v: ~masked_away(k)).alias("extra")
    )


def choose_unmask_source(originals: DataFrame, masked_lists: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per document, the saved masked content list when there is one,
    else the original items.  Only keys are compared; the items of the documents without follow their keys."""
    have = masked_lists.select(*key).distinct()
    without = stored(originals.select(*key).distinct().join(have, list(key), "left_anti"), "no_saved_list")
    from_masked = masked_lists.withColumn("source", F.lit("masked_list"))
    from_orig = C.join_keys(originals, without, list(key), "left_semi").withColumn("source", F.lit("original"))
    return from_masked.unionByName(from_orig, allowMissingColumns=True)


# ---------------------------------------------------------------------------
# K3, K4: writers
# ---------------------------------------------------------------------------

def item_json(of: Callable[[str], Column] = F.col) -> Column:
    """An item as it was read, with the ``text`` and ``title`` of its row; ``of``: a column of the item by its name."""

    def value(k: Column) -> Column:
        return (
            F.when((k == "text") & of("text").isNotNull(), of("text").cast("variant"))
            .when((k == "title") & of("title").isNotNull(), of("title").cast("variant"))
            .otherwise(F.element_at(of("extra"), k))
        )

    return F.coalesce(F.to_json(F.map_from_arrays(of("keys"), F.transform(of("keys"), value))), F.lit("null"))


def gather_items(items: DataFrame) -> DataFrame:
    """``path, items``, stored: the items of each document in one row (a document's items are one
    source document), from which both outputs are rendered."""
    item = F.struct(*[c for c in items.columns if c != "path"])
    return stored(items.groupBy("path").agg(F.collect_list(item).alias("items")), "gathered_items")


def gathered_rows(gathered: DataFrame) -> DataFrame:
    """The items of :func:`gather_items`, one a row."""
    return gathered.select("path", F.explode("items").alias("i")).select("path", "i.*")


def _rendered(piece: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``piece`` of every item, in the order of items."""
    rows = F.transform("items", lambda i: F.struct(i["item_idx"].alias("item_idx"), piece(lambda c: i[c]).alias("p")))
    return F.transform(F.array_sort(rows), lambda r: r["p"])


def write_outputs(gathered: DataFrame, folder: str, operation: str) -> None:
    """K2/K3: ``folder/lists`` (the JSON array of a document's items) and ``folder/markdown`` of ``path, out_name,
    content``, from :func:`gather_items`; ``operation`` is ``masked`` or ``unmasked``."""
    from ..operators.documents import markdown_piece

    lists = F.concat(F.lit("["), F.array_join(_rendered(item_json), ","), F.lit("]"))
    markdown = F.array_join(_rendered(markdown_piece), "")
    for kind, content, end in (("lists", lists, "_content_list.json"), ("markdown", markdown, ".md")):
        out_name = F.concat(stem(F.col("path")), F.lit(f"_{operation}{end}"))
        write_named(gathered.select("path", out_name.alias("out_name"), content.alias("content")), f"{folder}/{kind}")


def read_outputs(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``path, out_name, content`` that :func:`write_outputs` wrote (``lists`` or ``markdown``)."""
    return spark.read.schema(OUTPUT_SCHEMA).json(f"{folder}/{kind}")


def write_named(df: DataFrame, path: str) -> None:
    """K2/K3 sink: one JSON-Lines dataset (gzip files), one row per output name.  Spark's
    JSON writer keeps non-ASCII text unescaped (UTF-8)."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_entities(entities: DataFrame, path: str, key: str = "doc_id") -> None:
    """K4: per text ``{key, "output": [entities…]}`` as JSON Lines."""
    e = F.struct("type", "start", "end", "span", "prob")
    agg = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", e.alias("e")))).alias("_a"))
    write_named(agg.select(key, F.transform("_a", lambda x: x["e"]).alias("output")), path)
