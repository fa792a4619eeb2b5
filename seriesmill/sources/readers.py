"""Readers: JSON files, folders and ZIP archives of JSON as (source_name, payload text), and HTTP endpoints."""

from __future__ import annotations

import io
import os
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

TIMEOUT_S = 30
PLACEHOLDERS = ("", "xxx", "your_api_key", "changeme")


def resolve_input_path(folder: str, given: str | None = None) -> str:
    """The path given, else the folder's first .zip by name, else its first .json."""
    if given:
        return given
    names = sorted(os.listdir(folder))
    for suffix in (".zip", ".json"):
        for n in names:
            if n.endswith(suffix):
                return os.path.join(folder, n)
    raise FileNotFoundError(f"no .zip or .json in {folder}")


def zip_members(files: DataFrame, member: str | None = None) -> DataFrame:
    """Binary files (path, content) -> (archive, source_name, payload); of one member only that is decompressed."""

    def work(batches):
        for b in batches:
            names, members, texts = [], [], []
            for path, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in [member] if member else sorted(x for x in z.namelist() if x.endswith(".json")):
                        if n not in z.namelist():
                            raise FileNotFoundError(f"{n} in {path}")
                        names.append(path)
                        members.append(n)
                        texts.append(z.read(n).decode("utf-8"))
            yield pd.DataFrame({"archive": names, "source_name": members, "payload": texts})

    return files.select("path", "content").mapInPandas(work, "archive string, source_name string, payload string")


def read_payloads(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(source_name, payload text) of one JSON file, a folder of JSON files (nested too) or ZIP archives."""
    if path.endswith(".zip"):
        files = spark.read.format("binaryFile").load(path)
        return zip_members(files, member).select("source_name", "payload")
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return reader.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_name"), F.col("value").alias("payload"))


def load_synthetic_response(spark: SparkSession, zip_path: str, family: str, subtype: str, slot: str = "latest") -> str:
    """The text of one member; FileNotFoundError if it isn't there."""
    member = f"{family}/{subtype}/{slot}_raw.json"
    if not os.path.exists(zip_path):
        raise FileNotFoundError(zip_path)
    with zipfile.ZipFile(zip_path) as z:
        if member not in z.namelist():
            raise FileNotFoundError(f"{member} in {zip_path}")
    return read_payloads(spark, zip_path, member).first()["payload"]


def env_example(path: str) -> dict[str, str]:
    """KEY=value lines of an example file; comments and empty lines don't count."""
    out = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("'\"")
    return out


def api_key(provider: str, example: str = ".env.example") -> str | None:
    """The provider's key, else the common one, from the environment or from an example file."""
    values = {k: v for k, v in env_example(example).items() if v.lower() not in PLACEHOLDERS}
    for name in (f"{provider.upper()}_API_KEY", f"{provider.upper().replace('-', '_')}_API_KEY", "INPUT_API_KEY"):
        if os.environ.get(name) or values.get(name):
            return os.environ.get(name) or values[name]
    return None


def headers(provider: str, key: str | None) -> dict[str, str]:
    own = {} if not key else {"CG-API-KEY": key} if provider == "coinglass" else {"Authorization": f"Bearer {key}"}
    return {"accept": "application/json"} | own


def redact(h: dict[str, str]) -> dict[str, str]:
    """Headers without secrets, for what is written down."""
    return {k: "***" if "key" in k.lower() or k.lower() == "authorization" else v for k, v in h.items()}


def url_of(base: str, path: str, params: dict[str, str]) -> str:
    query = urllib.parse.urlencode(params)
    return base.rstrip("/") + "/" + path.lstrip("/") + (f"?{query}" if query else "")


def http_get(url: str, h: dict[str, str], timeout: float = TIMEOUT_S) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=h), timeout=timeout) as r:
        return r.read().decode("utf-8")


class HttpPayloads(DataSource):
    """format("http_payloads"): one partition a URL; a failed request is a row with its error, not a failed job.

    Options: urls (newline-separated), provider, timeout. Keys come from the executors' environment, never from options.
    """

    @classmethod
    def name(cls) -> str:
        return "http_payloads"

    def schema(self) -> str:
        return "url string, status string, payload string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str], get: Callable = http_get):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.provider, self.timeout, self.get = options.get("provider", ""), float(options.get("timeout", TIMEOUT_S)), get

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        try:
            yield partition.value, "ok", self.get(partition.value, headers(self.provider, api_key(self.provider)), self.timeout), None
        except (OSError, ValueError) as e:  # URL errors and timeouts are OSErrors
            yield partition.value, "live_request_failed", None, str(e)


def read_http(spark: SparkSession, urls: list[str], provider: str, timeout: float = TIMEOUT_S) -> DataFrame:
    spark.dataSource.register(HttpPayloads)
    return spark.read.format("http_payloads").option("urls", "\n".join(urls)).option("provider", provider).option("timeout", str(timeout)).load()
