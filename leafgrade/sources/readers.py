"""Sources (S1-S6, S9, S10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrade import schemas as SC

BAD = "_corrupt"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])


def parse_page_documents(df: DataFrame, json: str = "analysis") -> DataFrame:
    """Page JSON column to typed columns; null, blank or unreadable documents count as absent rows.

    The key columns stay; absent documents are dropped, never an error.
    """
    keys = [c for c in df.columns if c != json]
    parsed = F.from_json(F.col(json), _with_corrupt(SC.PAGE_DOCUMENT),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = df.where(F.col(json).isNotNull() & (F.trim(json) != "")).withColumn("_doc", parsed)
    good = rows.where(F.col("_doc").isNotNull() & F.col(f"_doc.{BAD}").isNull())
    return good.select(*keys, "_doc.*").drop(BAD)


def read_page_analyses(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one JSON document per file; adds ``source_file``. Unreadable files count as absent."""
    raw = spark.read.schema(_with_corrupt(SC.PAGE_DOCUMENT)).option("multiLine", True).option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    return raw.where(F.col(BAD).isNull() & F.col("pageNumber").isNotNull()).drop(BAD).withColumn(
        "source_file", F.col("_metadata.file_path"))


def with_legacy_defaults(docs: DataFrame) -> DataFrame:
    """Old documents: missing version becomes ``legacy``, missing arrays become empty."""
    out = docs.withColumn("schemaVersion", F.coalesce("schemaVersion", F.lit("legacy")))
    for name, element in SC.DOCUMENT_ARRAYS.items():
        if name in docs.columns:
            out = out.withColumn(name, F.coalesce(name, F.array().cast(T.ArrayType(element))))
    return out


def decode_typed_payload(payload: Column) -> Column:
    """The payload union by ``type``: only the fields of its own type stay; unknown types are null.

    Matching pairs that miss a side are dropped.
    """
    strings = F.filter(F.coalesce(payload["alternatives"], F.array().cast("array<string>")), lambda a: a.isNotNull())
    pairs = F.filter(payload["pairs"], lambda p: p.isNotNull() & p["leftLabel"].isNotNull() & p["rightLabel"].isNotNull())
    none = F.lit(None)

    def make(value=none, alternatives=none, pairs=none, model=none, hint=none) -> Column:
        return F.struct(
            payload["type"].alias("type"), value.cast("string").alias("value"),
            alternatives.cast("array<string>").alias("alternatives"),
            pairs.cast(T.ArrayType(SC.PAIR)).alias("pairs"), model.cast("string").alias("modelText"),
            hint.cast("string").alias("sourceHint"))

    kind = payload["type"]
    return (
        F.when((kind == "Text") & payload["value"].isNotNull(), make(payload["value"], strings))
        .when((kind == "Matching") & payload["pairs"].isNotNull(), make(pairs=pairs))
        .when((kind == "Reference") & payload["modelText"].isNotNull(),
              make(model=payload["modelText"], hint=F.coalesce(payload["sourceHint"], F.lit(""))))
    )


def parse_answer_keys(df: DataFrame, json: str = "entries") -> DataFrame:
    """S3: one key row per book to one row per entry, with entry defaults and ``entry_index``.

    An unreadable entry list counts as empty.
    """
    keys = [c for c in df.columns if c != json]
    schema = T.ArrayType(SC.KEY_ENTRY)
    entries = df.select(*keys, F.posexplode(F.from_json(F.col(json), schema)).alias("entry_index", "e"))
    e = F.col("e")
    empty = F.array().cast("array<string>")
    names = {
        "pageNumber": "page_number", "exerciseNumber": "exercise_number", "unitNumber": "unit_number",
        "subExerciseMarker": "marker", "interactionKind": "key_kind", "ordinal": "ordinal",
        "expectedValue": "expected_value", "confidence": "confidence",
    }
    kind_map = F.create_map(*[F.lit(v) for kv in SC.KEY_KIND_TO_INTERACTION.items() for v in kv])
    return entries.where(e.isNotNull()).select(
        *keys, "entry_index", *[e[src].alias(dst) for src, dst in names.items()],
        F.try_element_at(kind_map, e["interactionKind"]).alias("kind"),
        F.coalesce(e["items"], empty).alias("items"), F.coalesce(e["alternatives"], empty).alias("alternatives"),
        F.coalesce(e["caseSensitive"], F.lit(False)).alias("case_sensitive"),
        F.coalesce(e["punctuationRequired"], F.lit(False)).alias("punctuation_required"),
        F.coalesce(e["normalizationMode"], F.lit("strict")).alias("normalization_mode"),
        F.coalesce(e["rawSolutionText"], F.lit("")).alias("raw_text"),
        F.coalesce(e["mappingWarnings"], empty).alias("warnings"),
        decode_typed_payload(e["typedPayload"]).alias("payload"))


def parse_book_profiles(df: DataFrame, json: str = "metadata") -> dict[str, DataFrame]:
    """Profile rows (profile_id, ..., metadata JSON) to profiles, units and excluded ranges."""
    keys = [c for c in df.columns if c != json]
    p = df.withColumn("_m", F.from_json(F.col(json), SC.PROFILE_METADATA))
    profiles = p.select(*keys, F.col("_m.printedPageOffset").alias("printed_offset"),
                        F.col("_m.loesungenPdfRange")["from"].alias("solution_from"),
                        F.col("_m.loesungenPdfRange")["to"].alias("solution_to"))
    units = p.select("profile_id", F.posexplode("_m.units").alias("position", "u")).select(
        "profile_id", "position", F.col("u.unitNumber").alias("unit_number"), F.col("u.title").alias("title"),
        F.col("u.printedStartPage").alias("printed_start"))
    excluded = p.select("profile_id", F.explode("_m.nonUnitPrintedRanges").alias("r")).select(
        "profile_id", F.col("r")["from"].alias("range_from"), F.col("r")["to"].alias("range_to"))
    return {"profiles": profiles, "units": units, "excluded": excluded}


MAX_FILE_BYTES = 200 * 1024 * 1024


def register_manifest(files: DataFrame, digest: Column | None = None) -> DataFrame:
    """Book rows with a ``reject_reason`` (null = accepted).

    ``files``: name, mime, size and either ``content`` or a ``digest`` column.
    """
    name = F.col("name")
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    title = (
        F.when(name.isNull(), "Untitled")
        .when(name.contains(".") & (dot > 1), F.substring(name, F.lit(1), dot - 1))
        .otherwise(name)
    )
    reason = (
        F.when(F.coalesce("size", F.lit(0)) <= 0, "File is empty")
        .when(F.col("mime").isNull() | (F.col("mime") != "application/pdf"), "Only PDF files are accepted")
        .when(name.isNull() | ~F.lower(name).endswith(".pdf"), "File must have .pdf extension")
        .when(F.col("size") > MAX_FILE_BYTES, "File too large (max 200 MB)")
    )
    checksum = F.sha2(F.col("content"), 256) if digest is None else digest
    out = files.withColumn("title", title).withColumn("checksum", checksum).withColumn("reject_reason", reason)
    return out.drop("content") if digest is None else out


def register_books(spark: SparkSession, path: str, mime: str = "application/pdf") -> DataFrame:
    """Manifest of a folder of files. Files above the size limit are listed by size only, not read.

    The file listing skips empty files; a caller who must report them passes
    its own list to ``register_manifest``.
    """
    glob = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = glob.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(mime).alias("mime"),
                        F.col("length").alias("size"), "path", "modificationTime")
    # binaryFile refuses contents above its limit, so large files never reach the content read
    small = glob.where(F.col("length") <= MAX_FILE_BYTES).select("path", F.sha2("content", 256).alias("_sum"))
    joined = files.join(small, "path", "left")
    return register_manifest(joined, F.col("_sum")).drop("_sum")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None,
              partitions: int = 16, **options: str) -> DataFrame:
    """A relational table, read in parallel key ranges when bounds are given (driver jar needed)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", str(bounds[0])).option(
            "upperBound", str(bounds[1])).option("numPartitions", str(partitions))
    return reader.load()


def list_books(books: DataFrame) -> DataFrame:
    """Newest first."""
    return books.orderBy(F.desc("created_at"))


def list_pages(pages: DataFrame) -> DataFrame:
    """Pages of each book in page order."""
    return pages.orderBy("book_id", "page_number")
