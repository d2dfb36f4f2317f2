"""Awards and spending from a paged REST service as a Spark data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fiscalith.session import ship_package
from fiscalith.sources.discovery import canonical_names

SCHEMA = "agency string, fiscal_year int, level string, page int, record string, error string"
BASE_URL = "https://api.usaspending.gov/api/v2"
PAGE_SIZE = 100
# Fields of an award, as the service names them.
AWARD_FIELDS = [
    "Award ID",
    "Recipient Name",
    "Start Date",
    "End Date",
    "Award Amount",
    "Total Outlays",
    "Description",
    "Contract Award Type",
    "Award Type",
    "Awarding Agency",
    "Awarding Sub Agency",
    "Funding Agency",
    "Funding Sub Agency",
    "Place of Performance State Code",
    "Place of Performance Country Code",
    "NAICS Code",
    "NAICS Description",
    "Program Activity Name",
    "Program Activity Code",
    "Object Class",
    "Period of Performance Start Date",
    "Period of Performance Current End Date",
    "Last Date to Order",
    "SAI Number",
]
_NUMBERS = ("award_amount", "total_outlays")
_DATES = ("start_date", "end_date", "period_of_performance_start_date", "period_of_performance_current_end_date")
# Words by which research contracts are found.
RESEARCH_WORDS = ["research", "development", "test and evaluation", "RDT&E", "prototype", "advanced technology"]

#: Answers that asking again would not change.
FINAL_CODES = frozenset([400, 404, 422])


def request(url: str, body: dict | None = None, attempts: int = 4, pause: float = 2.0, opener: Callable = urllib.request.urlopen) -> dict:
    """JSON of a GET, or of a POST with ``body``; repeated with growing pauses but for answers that are final."""
    data = None if body is None else json.dumps(body).encode()
    for attempt in range(attempts):
        try:
            with opener(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=60) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as fault:
            if fault.code in FINAL_CODES or attempt + 1 == attempts:
                raise
        except urllib.error.URLError:
            if attempt + 1 == attempts:
                raise
        time.sleep(pause * 2**attempt)
    raise RuntimeError("unreachable")


def award_filters(agency_code: str, fiscal_year: int, award_types: list[str], keywords: list[str]) -> dict:
    """The service's own filter, so that it and not Spark discards what is not wanted."""
    out: dict = {
        "agencies": [{"type": "awarding", "tier": "toptier", "toptier_code": agency_code}],
        "time_period": [{"start_date": f"{fiscal_year - 1}-10-01", "end_date": f"{fiscal_year}-09-30"}],
        "award_type_codes": award_types,
    }
    if keywords:
        out["keywords"] = keywords
    return out


def pages(fetch: Callable[[int], dict]) -> Iterator[tuple[int, dict]]:
    """Records of page after page, until one is empty or says that there is none after it."""
    page = 1
    while True:
        answer = fetch(page)
        rows = answer.get("results") or []
        for row in rows:
            yield page, row
        about = answer.get("page_metadata") or {}
        if not rows or not (about.get("has_next_page") or about.get("hasNext")):
            return
        page += 1


#: Levels of the spending hierarchy.
LEVELS = ("federal_account", "program_activity", "object_class")


class _Part(InputPartition):
    def __init__(self, agency: str, fiscal_year: int, level: str = ""):
        self.agency, self.fiscal_year, self.level = agency, fiscal_year, level


class AwardReader(DataSourceReader):
    """One partition for each agency and fiscal year; the pages of one are read in turn.

    ``kind`` selects awards (default), spending (by level: one partition for each agency, year and level; one that the
    service does not answer has a row without record that says why in ``error``), toptier or subtier agencies.
    """

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Part]:
        split = lambda name: [x.strip() for x in self.options.get(name, "").split(",") if x.strip()]
        kind = self.options.get("kind", "awards")
        if kind == "toptier":
            return [_Part("", 0)]
        if kind == "subtier":
            return [_Part(a, 0) for a in split("agencies")]
        if kind == "spending":
            return [_Part(a, int(y), level) for a in split("agencies") for y in split("fiscalyears") for level in (split("levels") or LEVELS)]
        return [_Part(a, int(y)) for a in split("agencies") for y in split("fiscalyears")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        o = self.options
        base, kind = o.get("url", BASE_URL), o.get("kind", "awards")
        if kind in ("toptier", "subtier"):
            path = "/references/toptier_agencies/" if kind == "toptier" else f"/agency/{partition.agency}/sub_components/"
            for row in request(base + path).get("results") or []:
                yield partition.agency, None, None, 1, json.dumps(row), None
            return
        if kind == "spending":
            body = {"type": partition.level, "filters": {"fy": str(partition.fiscal_year), "quarter": "4", "agency": partition.agency}}
            try:
                answer = request(base + "/spending/", body)
            except urllib.error.HTTPError as fault:
                yield partition.agency, partition.fiscal_year, partition.level, 1, None, f"http {fault.code}"
                return
            for row in answer.get("results") or []:
                yield partition.agency, partition.fiscal_year, partition.level, 1, json.dumps(row), None
            return
        types = [x for x in o.get("awardtypes", "A,B,C,D").split(",") if x]
        words = [x for x in o.get("keywords", "").split(",") if x]
        limit = int(o.get("pagesize", PAGE_SIZE))

        def fetch(page: int) -> dict:
            wanted = award_filters(partition.agency, partition.fiscal_year, types, words)
            body = {"filters": wanted, "fields": AWARD_FIELDS, "sort": "Award Amount", "order": "desc", "page": page, "limit": limit}
            return request(base + "/search/spending_by_award/", body)

        for page, row in pages(fetch):
            yield partition.agency, partition.fiscal_year, None, page, json.dumps(row), None


class AwardSource(DataSource):
    """``spark.read.format("fiscal_awards")`` with options agencies, fiscalYears, awardTypes, keywords, pageSize and url."""

    @classmethod
    def name(cls) -> str:
        return "fiscal_awards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AwardReader:
        return AwardReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(AwardSource)


def read_awards(spark: SparkSession, agencies: list[str], fiscal_years: list[int], keywords: list[str] | None = None, **options: str) -> DataFrame:
    """Awards of agencies (by code) and fiscal years, a JSON text a record."""
    register(spark)
    reader = spark.read.format("fiscal_awards").options(**options)
    reader = reader.option("agencies", ",".join(agencies)).option("fiscalYears", ",".join(map(str, fiscal_years)))
    return reader.option("keywords", ",".join(keywords or [])).load()


def defense_research_awards(spark: SparkSession, fiscal_years: list[int], **options: str) -> DataFrame:
    """Awards of the defense department that speak of research and development."""
    return read_awards(spark, ["097"], fiscal_years, RESEARCH_WORDS, **options)


def intelligence_awards(spark: SparkSession, fiscal_years: list[int], **options: str) -> DataFrame:
    """Awards of the components with public records."""
    return read_awards(spark, ["202", "289", "012"], fiscal_years, **options)


def typed_awards(raw: DataFrame) -> DataFrame:
    """Records as columns of canonical names; amounts and dates that do not parse are null."""
    names = canonical_names(AWARD_FIELDS)
    given = F.from_json("record", "map<string,string>")
    fields = raw.select("agency", "fiscal_year", given.alias("__m")).select(
        "agency", "fiscal_year", *[F.col("__m")[field].alias(name) for field, name in zip(AWARD_FIELDS, names)]
    )
    typed = {c: F.col(c).try_cast("double") for c in _NUMBERS} | {c: F.try_to_timestamp(F.col(c)) for c in _DATES}
    return fields.withColumns(typed)


def read_spending(spark: SparkSession, agencies: list[str], fiscal_years: list[int], levels: list[str] | None = None, **options: str) -> DataFrame:
    """The spending hierarchy, flat: agency, fiscal year, level, record."""
    register(spark)
    reader = spark.read.format("fiscal_awards").options(kind="spending", **options).option("agencies", ",".join(agencies))
    reader = reader.option("fiscalYears", ",".join(map(str, fiscal_years)))
    return reader.option("levels", ",".join(levels or LEVELS)).load()
