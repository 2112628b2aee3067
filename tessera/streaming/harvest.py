"""Harvesting of a list that a service hands out page by page, each naming the next by a token.

The page to fetch next is the offset of a streaming source: Spark logs it before a batch runs, so a killed reader goes
on where it stood. A token that the service refuses starts the list again; records that the table holds already are
left out as a batch is written, which also makes a batch that runs twice harmless.
"""

from __future__ import annotations

import urllib.error
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.records import fetched

OAI = "{http://www.openarchives.org/OAI/2.0/}"
#: Status with which a token is refused.
REFUSED = 400


def page_of(body: bytes) -> tuple[list[tuple[str, str]], str | None]:
    """(identifier, XML) of a page's records, and the token of the next page."""
    root = ET.fromstring(body)  # noqa: S314
    rows = [(r.findtext(f"{OAI}header/{OAI}identifier"), ET.tostring(r, "unicode")) for r in root.iter(f"{OAI}record")]
    token = root.findtext(f".//{OAI}resumptionToken")
    return rows, (token or "").strip() or None


class HarvestSource(DataSource):
    """Stream of (id, page, record) from option `first`, the URL of the first page; the next ones keep its verb and carry their token."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return "id string, page long, record string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return HarvestReader(self.options["first"], int(self.options.get("tries", "5")))


class HarvestReader(SimpleDataSourceStreamReader):
    """Offsets: url (null at the list's end) and how many pages the list has had since it was last begun."""

    def __init__(self, first: str, tries: int = 5):
        self.first, self.tries = first, tries

    def initialOffset(self) -> dict:
        return {"url": self.first, "page": 0}

    def _page(self, at: dict) -> tuple[list[tuple], dict]:
        try:
            rows, token = page_of(fetched(at["url"], tries=self.tries))
        except urllib.error.HTTPError as e:
            if e.code != REFUSED or at["url"] == self.first:
                raise
            return self._page(self.initialOffset())
        verb = urllib.parse.parse_qs(urllib.parse.urlsplit(self.first).query).get("verb", ["ListRecords"])[0]
        follow = urllib.parse.urlencode({"verb": verb, "resumptionToken": token or ""})
        page = at["page"] + 1
        return [(i, page, x) for i, x in rows], {"url": f"{self.first.split('?')[0]}?{follow}" if token else None, "page": page}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["url"] is None:
            return iter([]), start
        rows, after = self._page(start)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch that runs again; if its token has expired since, all from the first page on to its last."""
        at = start
        while at["url"] is not None and at != end:
            begun = at["page"]
            rows, at = self._page(at)
            yield from rows
            if at["page"] >= end["page"] and (at["page"] > begun or at == end):
                return


def held_apart(spark: SparkSession, batch: DataFrame, out: str, key: str = "id") -> DataFrame:
    """The rows of a batch, one for each key, that the Parquet table `out` doesn't hold."""
    rows = batch.dropDuplicates([key])
    try:
        have = spark.read.parquet(out).select(key)
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return rows
    return rows.join(have, key, "left_anti")


def harvest(spark: SparkSession, first: str, out: str, state: str, tries: int = 5) -> DataFrame:
    """All records of the list as the table `out`; state is the folder of the stream's log, and another run goes on from there."""
    spark.dataSource.register(HarvestSource)

    def put(batch: DataFrame, _: int) -> None:
        held_apart(batch.sparkSession, batch, out).write.mode("append").parquet(out)

    rows = spark.readStream.format("harvest").option("first", first).option("tries", str(tries)).load()
    stream = rows.writeStream.foreachBatch(put).option("checkpointLocation", state).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.schema(rows.schema).parquet(out)


def papers(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """id and columns (name -> XPath) of harvested records, white space within a text made single."""
    bare = F.regexp_replace(F.regexp_replace("record", r"<(/?)[A-Za-z0-9_]+:", "<$1"), r'\sxmlns(:\w+)?="[^"]*"', "")
    x = records.select("id", bare.alias("__x"))
    text = lambda path: F.trim(F.regexp_replace(F.xpath_string("__x", F.lit(path)), r"\s+", " "))
    return x.select("id", *(text(path).alias(name) for name, path in columns.items()))
