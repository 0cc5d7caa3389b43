"""Sources and sinks of the record model."""

from __future__ import annotations

import ipaddress
import os
import tomllib
from dataclasses import dataclass, fields, replace
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators.model import READING


def images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}", most: int | None = None) -> DataFrame:
    """(path, stem, sha256, bytes) of image files; ``most`` takes the first by path (a feature of the scan)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    rows = found.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    return rows if most is None else rows.orderBy("path").limit(most)


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON files beside images, one object each, with the stem they share."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))


def with_images(cards: DataFrame, photos: DataFrame) -> DataFrame:
    """Sidecars with the image of their stem: .jpg before .jpeg before .png; those without one are left out."""
    order = F.array_position(F.array(F.lit("jpg"), F.lit("jpeg"), F.lit("png")), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    first = photos.groupBy("stem").agg(F.min_by(F.struct("path", "sha256", "bytes"), order).alias("image"))
    return cards.join(first, "stem").select(*cards.columns, "image.*")


def sidecar_csv(spark: SparkSession, path: str, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A CSV of image, patient, page_type and maybe note: rows whose image is there, and rows whose image is missing."""
    rows = spark.read.option("header", True).csv(path).withColumn("stem", F.regexp_extract("image", r"([^/]+?)(\.[^./]+)?$", 1))
    known = photos.select("stem").distinct()
    return rows.join(known, "stem", "left_semi"), rows.join(known, "stem", "left_anti")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Fields of page templates: one JSON file per page, with an array ``fields``; the file's name is the page."""
    shape = "fields array<struct<key:string,kind:string,type:string,label:string,row:string,col:string,`table`:string,context:string,origin:string,sensitive:boolean,bbox:array<double>>>"
    pages = spark.read.schema(shape).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    rows = pages.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("page_type"), F.explode("fields").alias("f"))
    return rows.select("page_type", "f.*").withColumn("sensitive", F.coalesce("sensitive", F.lit(False)))


def truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two-line-header truth files (page_type;T / cle;statut;valeur) as typed rows."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path, wholetext=True).withColumn("file", F.input_file_name())
    body = F.split(F.regexp_replace("value", "\r", ""), "\n")
    rows = lines.select("file", F.element_at(F.split(body[0], ";"), 2).alias("page_type"), F.posexplode(F.slice(body, 3, F.size(body))).alias("seq", "line"))
    cells = F.split("line", ";", 3)
    text = F.nullif(F.trim(F.get(cells, F.lit(2))), F.lit(""))
    status = F.upper(F.trim(F.get(cells, F.lit(1))))
    return rows.where(F.trim("line") != "").select(
        "file", "page_type", "seq", F.trim(cells[0]).alias("key"), status.alias("status"),
        F.when(status == "CONNU", text).alias("value"), text.alias("raw"), F.lower(text).isin("oui", "x", "1", "true").alias("checked"),
    )


def unknown_keys(truth: DataFrame, template: DataFrame) -> DataFrame:
    """Truth rows whose key the template of their page doesn't have; must be empty."""
    return truth.join(F.broadcast(template.select("page_type", "key")), ["page_type", "key"], "left_anti")


def checked_truth(truth: DataFrame, template: DataFrame) -> DataFrame:
    """The truth rows; raises if any key isn't in the template of its page, naming the first ones."""
    odd = unknown_keys(truth, template).select("page_type", "key").distinct().orderBy("page_type", "key").limit(10).collect()  # for the message
    if odd:
        raise ValueError("unknown keys: " + ", ".join(f"{r['page_type']}.{r['key']}" for r in odd))
    return truth


def truth_skeleton(template: DataFrame) -> DataFrame:
    """Every field that isn't sensitive: boxes as known and unchecked, texts as not given."""
    box = F.col("kind") == "checkbox"
    return template.where(~F.col("sensitive")).select(
        "page_type", "key", F.when(box, "CONNU").otherwise("NON_FOURNI").alias("status"), F.when(box, F.lit(False)).alias("checked")
    )


def recorded_readings(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Readings replayed by content hash and key; what wasn't recorded is an error, never invented."""
    found = requests.join(recorded, ["sha256", "key"], "left")
    return found.withColumn("state", F.coalesce("state", F.lit("erreur")))


def not_recorded(images: DataFrame, recorded: DataFrame) -> DataFrame:
    """Images whose hash no recording has: where a recording goes on."""
    return images.join(recorded.select("sha256").distinct(), "sha256", "left_anti")


def append_recordings(readings: DataFrame, path: str) -> DataFrame:
    """Add readings (sha256, key, ...) of images that aren't recorded yet; gives what was added.

    Rows are written by append, so a recording that was broken off goes on where it stopped.
    """
    spark = readings.sparkSession
    try:
        new = not_recorded(readings, spark.read.schema(readings.schema).json(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        new = readings
    new.write.mode("append").json(path)
    return new


def received(rows: DataFrame) -> DataFrame:
    """The server's rows in the order in which they came."""
    return rows.orderBy("received_at", "id")


def second_readings(zones: DataFrame, client) -> DataFrame:
    """The second reader's readings, of zones with numbers only; its client is injected like the first one's."""
    return read_zones(zones.where(F.col("type").isin("int", "quantity", "bp", "date")), client)


def write_records(fields: DataFrame, path: str) -> None:
    """One JSON object per dossier, pages and fields nested."""
    field = F.struct(*[c for c in fields.columns if c not in ("dossier_id", "page_type")])
    pages = fields.groupBy("dossier_id", "page_type").agg(F.sort_array(F.collect_list(field)).alias("fields"))
    whole = pages.groupBy("dossier_id").agg(F.sort_array(F.collect_list(F.struct("page_type", "fields"))).alias("pages"))
    whole.select(F.to_json(F.struct("dossier_id", "pages")).alias("value")).write.mode("overwrite").text(path)


def sealed(rows: DataFrame, payload: str, secret: str) -> DataFrame:
    """Encrypt the payload column (AES-GCM); technical columns stay clear for filters."""
    return rows.withColumn(payload, F.aes_encrypt(F.col(payload), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")))


def opened(rows: DataFrame, payload: str, secret: str) -> DataFrame:
    """Decrypt; a wrong secret gives null."""
    return rows.withColumn(payload, F.try_aes_decrypt(F.col(payload), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")).cast("string"))


def noisy_reader(truth: DataFrame, share: float = 0.08, seed: int = 0) -> DataFrame:
    """A simulated reader: the truth, with a share of readings wrong or illegible, by a hash of seed and key."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "image_id", "key"), F.lit(1_000_000)) / 1_000_000
    state = F.when(draw < share / 2, "illisible").otherwise("ecrit")
    text = F.when(draw < share / 2, F.lit(None)).when(draw < share, F.reverse("text")).otherwise(F.col("text"))
    return truth.select("image_id", "key", F.lit("simulated").alias("reader"), text.alias("text"), state.alias("state"), F.lit(0.95).alias("confidence"))


def read_zones(zones: DataFrame, client) -> DataFrame:
    """Readings by an injected client: ``client(list of zones) -> list of (text, state, confidence)``.

    The client is made once per task; zones without ink were filtered out before this stage.
    """
    import pandas as pd

    def run(batches):
        ask = client()
        for batch in batches:
            found = ask(batch.to_dict("records"))
            yield pd.DataFrame(
                {
                    "image_id": batch["image_id"], "key": batch["key"], "reader": "client", "text": [f[0] for f in found],
                    "state": [f[1] for f in found], "confidence": [f[2] for f in found], "extra": [{} for _ in found],
                }
            )

    return zones.mapInPandas(run, READING)


def local_endpoint(url: str, model: str = "") -> bool:
    """Whether a reader's address may be used: this machine, .local names or private addresses, no cloud models."""
    host = urlparse(url).hostname or ""
    if model.endswith("-cloud"):
        return False
    if host == "localhost" or host.endswith(".local"):
        return True
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return False
    return address.is_loopback or address.is_private


@dataclass(frozen=True)
class ReaderConfig:
    """Defaults of the reader."""

    url: str = "http://localhost:11434"
    model: str = ""
    batch: int = 8
    scale: float = 2.0
    timeout: float = 240.0
    parallel: int = 1
    think: bool = False
    allow_remote: bool = False


def load_config(path: str | None = None, prefix: str = "LOOMWELL_") -> ReaderConfig:
    """Settings from a TOML file's [reader] table, then from the environment."""
    config = ReaderConfig()
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            config = replace(config, **tomllib.load(f).get("reader", {}))
    for field in fields(config):
        raw = os.environ.get(prefix + field.name.upper())
        if raw is not None:
            kind = type(getattr(config, field.name))
            config = replace(config, **{field.name: raw.lower() in ("1", "true", "oui") if kind is bool else kind(raw)})
    if not config.allow_remote and not local_endpoint(config.url, config.model):
        raise ValueError(f"{config.url} isn't a local address")
    return config
