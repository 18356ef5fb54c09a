"""Listings, worklists and predicates over postings, companies, probes and runs."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def instant(as_of: str | Column) -> Column:
    return F.lit(as_of).cast(NTZ) if isinstance(as_of, str) else as_of


def clamp(n: int | None, default: int, low: int, high: int) -> int:
    return min(max(default if n is None else n, low), high)


def _named(companies: DataFrame) -> DataFrame:
    return companies.select(F.col("id").alias("company_id"), "ats", "slug")


def three_valued_target(df: DataFrame, col: str = "is_target") -> DataFrame:
    """Keeps true and unknown."""
    return df.where(~F.col(col).eqNullSafe(False))


def active_postings(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Open postings of known companies, with source and slug; repeated rows stay repeated."""
    return jobs.where("closed_at IS NULL").join(_named(companies), "company_id")


def postings_since(jobs: DataFrame, companies: DataFrame, window: str, as_of: str) -> DataFrame:
    """Open postings first seen inside a trailing window (its start is out, and so is a null time), newest first."""
    return active_postings(jobs, companies).where(F.col("first_seen_at") > instant(as_of) - F.expr(f"INTERVAL {window}")).orderBy(F.desc("first_seen_at"), "id")


def recent_postings(jobs: DataFrame, companies: DataFrame, target_only: bool = True, limit: int | None = None) -> DataFrame:
    """Newest open postings; limit from 1 to 100, 30 if none is given."""
    rows = active_postings(jobs, companies)
    rows = three_valued_target(rows) if target_only else rows
    return rows.withColumn("posted_at", F.coalesce("source_published_at", "first_seen_at")).orderBy(F.desc("posted_at"), "id").limit(clamp(limit, 30, 1, 100))


def posting_detail(jobs: DataFrame, companies: DataFrame, job_id: int) -> DataFrame:
    """One posting as a nested document."""
    row = jobs.where(F.col("id") == job_id).join(_named(companies), "company_id")
    return row.select("id", F.to_json(F.struct("title", "location", F.struct("ats", "slug").alias("company"))).alias("document"))


def page(df: DataFrame, order: list[Column], frm: int, to: int) -> DataFrame:
    """Rows frm..to (from 0, both included) in the given order, with the total; the offset is a sort with a limit."""
    total = df.agg(F.count("*").alias("total"))
    cut = df.orderBy(*order).limit(to + 1)
    ranked = cut.withColumn("rn", F.row_number().over(Window.orderBy(*order)) - 1)
    return ranked.where(F.col("rn") >= frm).crossJoin(F.broadcast(total)).drop("rn")


def browse_postings(jobs: DataFrame, companies: DataFrame, q: str | None = None, source: str | None = None, active: bool = True, remote: str | None = None, relevance: str | None = None, comp: bool = False, page_number: int = 1, size: int = 50) -> DataFrame:
    """One page of postings with the total: a part of the title, source, place of work, relevance (true, false, null), pay."""
    rows = jobs.join(_named(companies), "company_id")
    if q:
        rows = rows.where(F.col("title").ilike(f"%{q}%"))
    if source:
        rows = rows.where(F.col("ats") == source)
    if active:
        rows = rows.where("closed_at IS NULL")
    if remote:
        rows = rows.where(F.col("remote") == remote)
    if relevance:
        rows = rows.where({"true": F.col("is_target"), "false": ~F.col("is_target"), "null": F.col("is_target").isNull()}[relevance])
    if comp:
        rows = rows.where("comp_max IS NOT NULL")
    first = (page_number - 1) * size
    return page(rows.select("id", "title", "ats", "first_seen_at"), [F.desc("first_seen_at"), F.col("id")], first, first + size - 1)


def browse_companies(companies: DataFrame, q: str | None = None, source: str | None = None, state: str | None = None, page_number: int = 1, size: int = 50) -> DataFrame:
    """One page of companies with the total: a part of the slug, source, state (enabled, disabled, errored); most errors first."""
    rows = companies
    if q:
        rows = rows.where(F.col("slug").ilike(f"%{q}%"))
    if source:
        rows = rows.where(F.col("ats") == source)
    if state:
        rows = rows.where({"enabled": F.col("enabled"), "disabled": ~F.col("enabled"), "errored": F.col("consecutive_errors") > 0}[state])
    first = (page_number - 1) * size
    return page(rows.select("id", "ats", "slug", "enabled", "consecutive_errors"), [F.desc("consecutive_errors"), F.col("slug"), F.col("id")], first, first + size - 1)


def browse_probes(probes: DataFrame, run_id: str, mode: str = "all", page_number: int = 1, size: int = 50) -> DataFrame:
    """One page of a run's facts with the total: all, failed, blocked (403 and 429), or slowest first with unknown latency last."""
    rows = probes.where(F.col("run_id") == run_id)
    if mode == "failed":
        rows = rows.where("NOT schema_ok")
    if mode == "blocked":
        rows = rows.where(F.col("http_status").isin(403, 429))
    order = [F.desc_nulls_last("latency_ms"), F.col("id")] if mode == "slowest" else [F.desc("created_at"), F.col("id")]
    first = (page_number - 1) * size
    return page(rows.select("id", "company_id", "http_status", "latency_ms", "created_at"), order, first, first + size - 1)


def browse_scans(runs: DataFrame, status: str | None = None, page_number: int = 1, size: int = 30) -> DataFrame:
    """One page of runs with the total, newest first."""
    rows = runs.where(F.col("status") == status) if status else runs
    first = (page_number - 1) * size
    return page(rows.select("id", "started_at", "status"), [F.desc("started_at"), F.col("id")], first, first + size - 1)


def title_search(jobs: DataFrame, companies: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Newest open postings with a text in their title, in any case."""
    return active_postings(jobs, companies).where(F.col("title").ilike(f"%{q}%")).select("id", "title", "slug", "first_seen_at").orderBy(F.desc("first_seen_at"), "id").limit(limit)


def pending_work(jobs: DataFrame, stage: str, cap: int) -> DataFrame:
    """Oldest open postings, not known noise, that lack a stage's result."""
    return three_valued_target(jobs.where("closed_at IS NULL").where(F.col(stage).isNull())).select("id", "company_id").orderBy("id").limit(cap)


def candidate_backlog(pool: DataFrame, in_use: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Of each source's candidates not in use, the newest and most mentioned, up to the source's budget."""
    budget = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])
    free = pool.join(in_use.select("ats", "slug"), ["ats", "slug"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("ats").orderBy(F.desc("latest_year"), F.desc("hits"), "slug"))
    return free.withColumn("rn", rn).where(F.col("rn") <= F.coalesce(F.try_element_at(budget, F.col("ats")), F.lit(0)))


def failing_companies(companies: DataFrame, min_errors: int = 3) -> DataFrame:
    """Companies with so many errors in a row, most first; unknown counts are none."""
    return companies.where(F.col("consecutive_errors") >= min_errors).select("id", "slug", "consecutive_errors").orderBy(F.desc("consecutive_errors"), "slug")


def disabled_companies(companies: DataFrame) -> DataFrame:
    """Companies that are off, the newest error first, unknown times last."""
    return companies.where("NOT enabled").select("id", "slug", "last_error_at").orderBy(F.desc_nulls_last("last_error_at"), "slug")


#: States with their short names, and what a location may say for a country.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc", "washington dc": "dc",
}
COUNTRIES = {
    "united states": ["united states", "united states of america", "usa", "u.s.a.", "u.s.", "us", "america", "stateside"],
    "united kingdom": ["united kingdom", "uk", "u.k.", "great britain", "britain", "england", "scotland", "wales", "northern ireland"],
    "canada": ["canada"],
    "germany": ["germany", "deutschland"],
    "india": ["india"],
    "ireland": ["ireland"],
    "france": ["france"],
    "spain": ["spain"],
    "portugal": ["portugal"],
    "netherlands": ["netherlands", "the netherlands", "holland"],
    "australia": ["australia"],
}


def place_names(query: str) -> list[str]:
    """What a location may say for a query: a country's names (with the states of the US), a state's two, or itself."""
    text = query.strip().lower()
    for names in COUNTRIES.values():
        if text in names:
            return names + [x for pair in STATES.items() for x in pair] if "usa" in names else names
    if text in STATES:
        return [text, STATES[text]]
    long = [name for name, short in STATES.items() if short == text]
    return [long[-1], text] if long else [text]


def _says(location: Column, name: str) -> Column:
    """Short names and those with a full stop must stand by themselves, others may be anywhere."""
    if len(name) <= 3 or "." in name:
        return location.rlike(rf"(^|[^a-z])\Q{name}\E([^a-z]|$)")
    return F.contains(location, F.lit(name))


def location_match(df: DataFrame, col: str, query: str) -> DataFrame:
    """Rows whose location has one of the query's names; a blank query keeps all rows, an empty location is nowhere."""
    if not query or not query.strip():
        return df
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    met = F.lit(False)
    for name in place_names(query):
        met = met | _says(low, name)
    return df.where((low != "") & met)


class NameFinder:
    """Finds all names of many queries in one pass over a text; it goes to workers as its names and is built there once."""

    def __init__(self, queries: list[str]):
        self.names: dict[str, list[str]] = {}
        for query in queries:
            for name in place_names(query):
                self.names.setdefault(name, []).append(query)
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "automaton": None}

    def queries_in(self, place: str) -> set[str]:
        """The queries of which a name is in the place; short names and those with a full stop only by themselves."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for name, queries in self.names.items():
                self.automaton.add_word(name, (len(name), len(name) <= 3 or "." in name, queries))
            self.automaton.make_automaton()
        found: set[str] = set()
        letter = lambda at: 0 <= at < len(place) and "a" <= place[at] <= "z"
        for end, (length, alone, queries) in self.automaton.iter(place):
            if not alone or not (letter(end - length) or letter(end + 1)):
                found.update(queries)
        return found


def location_matches(df: DataFrame, key: str, col: str, queries: list[str]) -> DataFrame:
    """(query, key) for many stated queries: each distinct location is read once for all names of all queries.

    The names of a query are a handful (a hundred for the US); they are broadcast and looked for by one automaton, so the
    work grows with the locations and what is found, not with locations times names. Rows then join the locations. A
    blank query keeps all rows, an empty location is nowhere.
    """
    low = df.select(F.col(key), F.lower(F.coalesce(F.col(col), F.lit(""))).alias("_place"))
    blank = [F.lit(q) for q in dict.fromkeys(queries) if not q or not q.strip()]
    out = low.select(F.explode(F.array(*blank) if blank else F.array().cast("array<string>")).alias("query"), key)
    asked = [q for q in dict.fromkeys(queries) if q and q.strip()]
    if not asked:
        return out
    finder = df.sparkSession.sparkContext.broadcast(NameFinder(asked))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_pylist()
            found = [finder.value.queries_in(p) for p in places]
            rows = [(q, p) for p, qs in zip(places, found, strict=True) for q in qs]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string())], names=["query", "_place"])

    met = low.select("_place").where("_place != ''").distinct().mapInArrow(find, "query string, _place string")
    return out.unionByName(low.join(met, "_place").select("query", key))
