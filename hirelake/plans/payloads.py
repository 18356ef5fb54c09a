"""Payload and location operators over payloads that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources import postings as P
from .registry import register

_BODIES = """CASE id % 6
WHEN 0 THEN to_json(named_struct('jobs', array(named_struct('id', id, 'title', title, 'location', named_struct('name', location), 'absolute_url', concat('https://b/', external_id), 'content', concat('&lt;p&gt;', title, '&lt;/p&gt;'), 'updated_at', date_format(first_seen_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")))))
WHEN 1 THEN to_json(named_struct('jobs', array(named_struct('id', external_id, 'title', title, 'location', location, 'jobUrl', concat('https://a/', external_id), 'descriptionPlain', title, 'isRemote', remote = 'remote', 'compensation', named_struct('compensationTiers', array(named_struct('components', array(named_struct('compensationType', 'Equity', 'maxValue', CAST(NULL AS DOUBLE), 'interval', '1 YEAR'), named_struct('compensationType', 'Salary', 'maxValue', comp_max, 'interval', '1 YEAR')))))))))
WHEN 2 THEN to_json(array(named_struct('id', external_id, 'text', title, 'categories', named_struct('location', location), 'hostedUrl', concat('https://l/', external_id), 'description', concat('<p>', title, '</p>'), 'workplaceType', remote, 'createdAt', unix_seconds(CAST(first_seen_at AS TIMESTAMP)))))
WHEN 3 THEN to_json(named_struct('content', array(named_struct('id', external_id, 'name', title, 'location', named_struct('city', location, 'country', 'xx'), 'companyName', 'c'))))
WHEN 4 THEN concat('<div data-page="', replace(to_json(named_struct('props', named_struct('company', named_struct('jobs', array(named_struct('id', id, 'title', title, 'location', location, 'salaryRange', '$120K - $180K')))))), '"', '&quot;'), '"></div>')
ELSE to_json(named_struct('jobPostings', array(named_struct('title', title, 'locationsText', location, 'externalPath', concat('/job/', external_id))), '_wd', named_struct('host', 'h', 'site', 's'))) END"""
_ATS = "CASE id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'lever' WHEN 3 THEN 'smartrecruiters' WHEN 4 THEN 'workatastartup' ELSE 'workday' END"
_EXPECTED = f"""SELECT {_ATS} AS ats, company_id, CASE WHEN id % 6 = 5 THEN '/job/' || external_id ELSE external_id END AS external_id, title,
CASE WHEN id % 6 = 3 THEN concat_ws(', ', location, 'xx') ELSE coalesce(location, '') END AS location,
CASE id % 6 WHEN 0 THEN 'https://b/' WHEN 1 THEN 'https://a/' WHEN 2 THEN 'https://l/' WHEN 3 THEN 'https://jobs.smartrecruiters.com/c/' WHEN 4 THEN 'https://www.workatastartup.com/jobs/' ELSE 'https://h/s/job/' END || external_id AS url,
CASE WHEN id % 6 < 3 THEN title END AS description, CASE id % 6 WHEN 1 THEN comp_max WHEN 4 THEN 180000.0 END AS comp_max, CASE WHEN id % 6 = 1 THEN 'year' END AS comp_interval,
CASE WHEN id % 6 = 1 AND remote = 'remote' OR id % 6 = 2 THEN remote END AS remote, CASE WHEN id % 6 = 0 THEN first_seen_at END AS source_updated_at, CASE WHEN id % 6 = 2 THEN first_seen_at END AS source_published_at FROM jobs"""


def _raw(jobs: DataFrame) -> DataFrame:
    """One payload for each posting, the board by its id."""
    return jobs.select("id", F.expr(_ATS).alias("ats"), "company_id", "external_id", F.expr(_BODIES).alias("body"))


register("normalize_postings", _EXPECTED, "jobs")(lambda j: P.normalize_postings(_raw(j)).select("ats", "company_id", "external_id", "title", "location", "url", "description", "comp_max", "comp_interval", "remote", "source_updated_at", "source_published_at"))
register("embedded_json_extract", "SELECT id, title FROM jobs WHERE id % 6 = 4", "jobs")(
    lambda j: P.embedded_json_extract(_raw(j).where("ats = 'workatastartup'"), P.SHAPES["workatastartup"], "body").select("id", F.col("parsed.props.company.jobs")[0]["title"].alias("title"))
)
_DETAILS = """CASE WHEN id % 2 = 0 THEN to_json(named_struct('jobAd', named_struct('sections', named_struct('jobDescription', named_struct('text', concat('<p>', title, '</p>')))), 'compensation', named_struct('max', comp_max, 'period', 'MONTHLY'), 'location', named_struct('city', location)))
ELSE to_json(named_struct('jobPostingInfo', named_struct('location', location, 'jobDescription', title, 'timeType', 'Full time', 'startDate', date_format(first_seen_at, 'yyyy-MM-dd')))) END"""
register("normalize_details", "SELECT external_id, title AS description, location, CASE WHEN id % 2 = 1 THEN 'Full time' END AS employment_type, CASE WHEN id % 2 = 0 THEN comp_max END AS comp_max, CASE WHEN id % 2 = 0 THEN 'month' END AS comp_interval, CASE WHEN location IS NOT NULL THEN 'onsite' END AS remote, CASE WHEN id % 2 = 1 THEN CAST(CAST(first_seen_at AS DATE) AS TIMESTAMP) END AS source_published_at FROM jobs", "jobs")(
    lambda j: P.normalize_details(j.select("company_id", "external_id", F.expr("CASE WHEN id % 2 = 0 THEN 'smartrecruiters' ELSE 'workday' END").alias("ats"), F.expr(_DETAILS).alias("body"))).select("external_id", "description", "location", "employment_type", "comp_max", "comp_interval", "remote", "source_published_at")
)

_FIELDS = "SELECT vec_id AS {0}, unnest(['role', 'other']) AS label, unnest([embedding[1:32], embedding[33:64]]) AS v FROM embeddings"
_SIM = "list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(a.v AS DOUBLE[])) * list_dot_product(CAST(b.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])))"


def _fields(vectors: DataFrame, name: str) -> DataFrame:
    halves = F.array(F.struct(F.lit("role").alias("label"), F.slice("embedding", 1, 32).alias("vector")), F.struct(F.lit("other").alias("label"), F.slice("embedding", 33, 32).alias("vector")))
    return vectors.select(F.col("vec_id").alias(name), F.explode(halves).alias("h")).select(name, "h.*")


register("field_weighted_similarity", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weighted DESC, item) AS rank FROM (SELECT query, item, round(sum(w * s) / sum(w), 4) AS weighted, round(avg(s), 4) AS plain FROM (SELECT query, item, CASE label WHEN 'role' THEN 2.0 ELSE 0.5 END::DOUBLE AS w, s FROM (SELECT a.query, b.item, a.label, {_SIM} AS s FROM ({_FIELDS.format('query')} WHERE vec_id % 100 = 0) a JOIN ({_FIELDS.format('item')}) b ON a.label = b.label) x) y GROUP BY query, item) z) r WHERE rank <= 10", "embeddings")(
    lambda e: R.field_weighted_similarity(_fields(e, "item"), _fields(e.where("vec_id % 100 = 0"), "query"), 10)
)
_QUERY = [1.0] * 64
_NEAR = "SELECT vec_id AS item, CASE vec_id % 3 WHEN 0 THEN 'Dallas, USA' WHEN 1 THEN 'Berlin' END AS location, CASE WHEN vec_id % 2 = 0 THEN 'remote' END AS remote, CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id % 50 AS DOUBLE) END AS fit"
register("location_filtered_match", f"SELECT item, similarity, fit, row_number() OVER (ORDER BY fit DESC NULLS LAST, similarity DESC, item) AS rank FROM (SELECT * FROM (SELECT * FROM ({_NEAR}, round(list_sum(CAST(embedding AS DOUBLE[])) / sqrt(64 * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS similarity FROM embeddings) n ORDER BY similarity DESC, item LIMIT 250) p WHERE remote = 'remote' AND location = 'Dallas, USA' ORDER BY similarity DESC, item LIMIT 40) q ORDER BY rank LIMIT 15", "embeddings")(
    lambda e: R.location_filtered_match(e.selectExpr("vec_id AS item", "embedding AS vector", "CASE vec_id % 3 WHEN 0 THEN 'Dallas, USA' WHEN 1 THEN 'Berlin' END AS location", "CASE WHEN vec_id % 2 = 0 THEN 'remote' END AS remote"), _QUERY, e.selectExpr("vec_id AS item", "CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id % 50 AS DOUBLE) END AS fit"), location="United States", remote="remote")
)
