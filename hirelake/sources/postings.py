"""Payloads of six job boards to one table of postings.

A payload is a row (ats, company_id, body). All six shapes are read in one pass: each board picks its fields
inside its array, the array is exploded once, and text is cleaned after that, in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import archive_replay
from ..operators.text import clean_html, compensation

_LABEL = "STRUCT<label: STRING>"
#: The fields that each board's payload has.
SHAPES = {
    "greenhouse": "STRUCT<jobs: ARRAY<STRUCT<id: STRING, title: STRING, location: STRUCT<name: STRING>, absolute_url: STRING, departments: ARRAY<STRUCT<name: STRING>>, content: STRING, updated_at: STRING, first_published: STRING>>>",
    "ashby": "STRUCT<jobs: ARRAY<STRUCT<id: STRING, title: STRING, location: STRING, jobUrl: STRING, department: STRING, employmentType: STRING, descriptionPlain: STRING, descriptionHtml: STRING, isRemote: BOOLEAN, updatedAt: STRING, publishedAt: STRING, compensation: STRUCT<compensationTierSummary: STRING, compensationTiers: ARRAY<STRUCT<tierSummary: STRING, components: ARRAY<STRUCT<compensationType: STRING, minValue: DOUBLE, maxValue: DOUBLE, currencyCode: STRING, interval: STRING, summary: STRING>>>>>>>>",
    "lever": "ARRAY<STRUCT<id: STRING, text: STRING, categories: STRUCT<location: STRING, department: STRING, commitment: STRING>, hostedUrl: STRING, applyUrl: STRING, descriptionPlain: STRING, description: STRING, lists: ARRAY<STRUCT<text: STRING, content: STRING>>, salaryRange: STRUCT<min: DOUBLE, max: DOUBLE, currency: STRING, interval: STRING>, workplaceType: STRING, createdAt: STRING>>",
    "smartrecruiters": f"STRUCT<content: ARRAY<STRUCT<id: STRING, uuid: STRING, name: STRING, location: STRUCT<city: STRING, country: STRING, remote: BOOLEAN>, company: STRUCT<identifier: STRING>, companyName: STRING, department: {_LABEL}, typeOfEmployment: {_LABEL}, releasedDate: STRING, function: {_LABEL}, industry: {_LABEL}, experienceLevel: {_LABEL}>>>",
    "workatastartup": "STRUCT<props: STRUCT<company: STRUCT<jobs: ARRAY<STRUCT<id: STRING, title: STRING, location: STRING, jobType: STRING, salaryRange: STRING, remote: BOOLEAN>>>>>",
    "workday": "STRUCT<jobPostings: ARRAY<STRUCT<title: STRING, locationsText: STRING, externalPath: STRING, bulletFields: ARRAY<STRING>>>, _wd: STRUCT<host: STRING, site: STRING>>",
}
#: What a board picks for a posting, before text, pay, place and time are put into one form.
PICKED = {
    "external_id": "string", "title": "string", "location": "string", "url": "string", "department": "string", "employment_type": "string",
    "plain": "string", "markup": "array<string>", "comp_min": "double", "comp_max": "double", "comp_currency": "string", "pay_interval": "string", "comp_text": "string",
    "place": "string", "updated": "string", "published": "string", "sr_function": "string", "sr_industry": "string", "sr_experience_level": "string",
}


def _picked(**fields: Column) -> Column:
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in PICKED.items()])


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def _if_remote(flag: Column) -> Column:
    return F.when(flag, "remote")


def _span(low: Column, high: Column) -> Column:
    """Both ends of a pay range as text; null if there is none."""
    ends = [F.call_function("format_number", x, F.lit("#,##0.###")) for x in (low, high)]
    return F.when(low.isNotNull() | high.isNotNull(), F.concat_ws(" – ", *ends))


def _greenhouse(j: Column) -> Column:
    return _picked(external_id=j.id, title=j.title, location=j.location["name"], url=j.absolute_url, department=F.get(j.departments, F.lit(0))["name"], markup=F.array(j.content), updated=j.updated_at, published=j.first_published)


def _ashby(j: Column) -> Column:
    tier = F.get(j.compensation.compensationTiers, F.lit(0))
    pay = F.get(F.filter(tier.components, lambda c: F.lower(c.compensationType).contains("salary")), F.lit(0))
    return _picked(
        external_id=j.id, title=j.title, location=j.location, url=j.jobUrl, department=j.department, employment_type=j.employmentType,
        plain=j.descriptionPlain, markup=F.when(_filled(j.descriptionPlain).isNull(), F.array(j.descriptionHtml)),
        comp_min=pay.minValue, comp_max=pay.maxValue, comp_currency=pay.currencyCode, pay_interval=pay["interval"], comp_text=_filled(j.compensation.compensationTierSummary, tier.tierSummary, pay.summary),
        place=_if_remote(j.isRemote), updated=j.updatedAt, published=j.publishedAt,
    )


def _lever(j: Column) -> Column:
    lists = F.flatten(F.transform(F.coalesce(j.lists, F.array()), lambda x: F.array(x.text, x.content)))
    pay = j.salaryRange
    return _picked(
        external_id=j.id, title=j.text, location=j.categories.location, url=_filled(j.hostedUrl, j.applyUrl), department=j.categories.department, employment_type=j.categories.commitment,
        plain=j.descriptionPlain, markup=F.when(_filled(j.descriptionPlain).isNull(), F.concat(F.array(j.description), lists)).otherwise(lists),
        comp_min=pay.min, comp_max=pay.max, comp_currency=pay.currency, pay_interval=pay["interval"], comp_text=_span(pay.min, pay.max), place=j.workplaceType, published=j.createdAt,
    )


def _smartrecruiters(j: Column) -> Column:
    owner, key = _filled(j.company.identifier, j.companyName), _filled(j.id)
    url = F.when(key.isNotNull(), F.concat(F.lit("https://jobs.smartrecruiters.com/"), owner, F.lit("/"), key)).otherwise(F.concat(F.lit("https://careers.smartrecruiters.com/"), owner))
    return _picked(
        external_id=_filled(j.id, j.uuid), title=j["name"], location=F.concat_ws(", ", _filled(j.location.city), _filled(j.location.country)), url=url, department=j.department.label, employment_type=j.typeOfEmployment.label,
        place=_if_remote(j.location.remote), published=j.releasedDate, sr_function=j.function.label, sr_industry=j.industry.label, sr_experience_level=j.experienceLevel.label,
    )


def _workatastartup(j: Column) -> Column:
    return _picked(external_id=j.id, title=j.title, location=j.location, url=F.concat(F.lit("https://www.workatastartup.com/jobs/"), j.id), employment_type=j.jobType, comp_text=j.salaryRange, place=_if_remote(j.remote))


def _workday(site: Column):
    def pick(j: Column) -> Column:
        listed = F.get(F.filter(j.bulletFields, lambda x: x != ""), F.lit(0))
        url = F.when(_filled(j.externalPath).isNotNull(), F.concat(F.lit("https://"), _filled(site.host), F.lit("/"), _filled(site.site), j.externalPath))
        return _picked(external_id=_filled(j.externalPath, listed), title=j.title, location=j.locationsText, url=url)

    return pick


def embedded_json(col: Column | str, attr: str = "data-page") -> Column:
    """The JSON text of an HTML attribute, its five entities decoded, the ampersand last; null without the attribute."""
    out = F.nullif(F.regexp_extract(col, rf'{attr}="([^"]+)"', 1), F.lit(""))
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def embedded_json_extract(pages: DataFrame, schema: str, col: str = "html", attr: str = "data-page") -> DataFrame:
    """Pages with ``parsed``, the document in an attribute; null where there is none or it is no JSON."""
    return pages.withColumn("parsed", F.from_json(embedded_json(col, attr), schema))


def instant_of(col: Column | str) -> Column:
    """An instant of ISO text, epoch seconds or epoch milliseconds, in UTC and without a zone; null for anything else."""
    raw = F.col(col) if isinstance(col, str) else col
    digits = F.when(raw.rlike(r"^\d{1,17}$"), raw.cast("long"))
    moment = F.when(digits >= 10**12, F.timestamp_millis(digits)).when(digits.isNotNull(), F.timestamp_seconds(digits)).otherwise(F.try_to_timestamp(raw))
    return moment.cast("timestamp_ntz")


def remote_of(place: Column | str, location: Column | str) -> Column:
    """remote, hybrid or onsite, by the board's own flag or else a word of the location; null if neither tells."""
    flag, low = F.regexp_replace(F.lower(place), r"[-_\s]+", ""), F.lower(location)
    said = F.when(flag.isin("remote", "hybrid", "onsite"), flag).when(flag.isin("inoffice", "inperson"), "onsite")
    return F.coalesce(said, F.when(low.rlike(r"\bremote\b"), "remote").when(low.rlike(r"\bhybrid\b"), "hybrid"))


def interval_of(raw: Column | str) -> Column:
    low = F.lower(raw)
    return F.when(low.rlike("year|annual"), "year").when(low.contains("month"), "month").when(low.contains("week"), "week").when(low.rlike("day|daily"), "day").when(low.contains("hour"), "hour")


def _cleaned(parts: Column) -> Column:
    """Pieces of markup as texts with a blank line between; empty pieces go."""
    return F.array_join(F.filter(F.transform(parts, clean_html), lambda x: x != ""), "\n\n")


def normalize_postings(raw: DataFrame) -> DataFrame:
    """One row for each posting of each payload, every column always there.

    Title, location and url are empty where the board gives none; other fields are null. A body that is empty, null,
    of another shape or no JSON has no postings, and so has an unknown board; ``rejected_payloads`` lists those.
    """
    body = {name: F.from_json(embedded_json("body") if name == "workatastartup" else F.col("body"), shape) for name, shape in SHAPES.items()}
    # a lone object reads as an array of one
    body["lever"] = F.when(F.ltrim("body").startswith("["), body["lever"])
    picked = {
        "greenhouse": F.transform(body["greenhouse"].jobs, _greenhouse),
        "ashby": F.transform(body["ashby"].jobs, _ashby),
        "lever": F.transform(body["lever"], _lever),
        "smartrecruiters": F.transform(body["smartrecruiters"].content, _smartrecruiters),
        "workatastartup": F.transform(body["workatastartup"].props.company.jobs, _workatastartup),
        "workday": F.transform(body["workday"].jobPostings, _workday(body["workday"]._wd)),
    }
    found = None
    for name, postings in picked.items():
        found = F.when(F.col("ats") == name, postings) if found is None else found.when(F.col("ats") == name, postings)
    rows = raw.select("ats", "company_id", F.explode(found).alias("p")).select("ats", "company_id", "p.*")
    free, pay = F.col("ats") == "workatastartup", compensation("comp_text")
    low, high, currency, interval = pay
    tidy = F.trim(F.regexp_replace("plain", r"[ \t ]+", " "))
    text = F.concat_ws("\n\n", F.when(tidy != "", tidy), F.nullif(_cleaned(F.col("markup")), F.lit("")))
    return rows.select(
        "ats", "company_id", F.coalesce("external_id", F.lit("")).alias("external_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "location", "url")],
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("department", "employment_type")], F.nullif(text, F.lit("")).alias("description"),
        F.when(free, low).otherwise(F.col("comp_min")).alias("comp_min"), F.when(free, high).otherwise(F.col("comp_max")).alias("comp_max"), F.when(free, currency).otherwise(F.nullif(F.col("comp_currency"), F.lit(""))).alias("comp_currency"),
        F.when(free, interval).otherwise(interval_of("pay_interval")).alias("comp_interval"), F.nullif(F.col("comp_text"), F.lit("")).alias("comp_text"),
        remote_of("place", "location").alias("remote"), instant_of("updated").alias("source_updated_at"), instant_of("published").alias("source_published_at"), "sr_function", "sr_industry", "sr_experience_level",
    )


def rejected_payloads(raw: DataFrame) -> DataFrame:
    """Payloads of an unknown board, and those that are no JSON (none in the page's attribute); an empty document is fine."""
    text = F.when(F.col("ats") == "workatastartup", embedded_json("body")).otherwise(F.col("body"))
    return raw.where(~F.coalesce(F.col("ats").isin(*SHAPES), F.lit(False)) | F.try_parse_json(text).isNull())


_DETAIL = {
    "smartrecruiters": f"STRUCT<jobAd: STRUCT<sections: STRUCT<jobDescription: STRUCT<text: STRING>, responsibilities: STRUCT<text: STRING>, qualifications: STRUCT<text: STRING>, additionalInformation: STRUCT<text: STRING>>>, compensation: STRUCT<min: DOUBLE, max: DOUBLE, currency: STRING, period: STRING>, location: STRUCT<remote: BOOLEAN, hybrid: BOOLEAN, city: STRING, country: STRING, fullLocation: STRING>, department: {_LABEL}, typeOfEmployment: {_LABEL}, releasedDate: STRING, function: {_LABEL}, industry: {_LABEL}, experienceLevel: {_LABEL}>",
    "workday": "STRUCT<jobPostingInfo: STRUCT<location: STRING, jobDescription: STRING, timeType: STRING, externalUrl: STRING, startDate: STRING>>",
}


def normalize_details(raw: DataFrame) -> DataFrame:
    """Detail payloads (ats, company_id, external_id, body) as description and fields; what is missing is null.

    A place without a word or flag for remote or hybrid work is onsite. A body that can't be read keeps its row.
    """
    sr, wd = F.from_json("body", _DETAIL["smartrecruiters"]), F.from_json("body", _DETAIL["workday"])["jobPostingInfo"]
    parts, loc, pay = sr.jobAd.sections, sr.location, sr.compensation
    here = _filled(loc.fullLocation, F.concat_ws(", ", _filled(loc.city), _filled(loc.country)))
    span = F.concat_ws(" ", _span(pay.min, pay.max), _filled(pay.currency))
    smart = _picked(
        location=here, department=sr.department.label, employment_type=sr.typeOfEmployment.label, markup=F.array(parts.jobDescription.text, parts.responsibilities.text, parts.qualifications.text, parts.additionalInformation.text),
        comp_min=pay.min, comp_max=pay.max, comp_currency=_filled(pay.currency), pay_interval=pay.period, comp_text=F.when(pay.min.isNotNull() | pay.max.isNotNull(), span),
        place=F.when(loc.remote, "remote").when(loc.hybrid, "hybrid").when(here.isNotNull(), "onsite"), published=sr.releasedDate, sr_function=sr.function.label, sr_industry=sr.industry.label, sr_experience_level=sr.experienceLevel.label,
    )
    site = _filled(wd.location)
    day = _picked(location=site, url=_filled(wd.externalUrl), employment_type=_filled(wd.timeType), markup=F.array(wd.jobDescription), place=F.coalesce(remote_of(F.lit(None).cast("string"), site), F.when(site.isNotNull(), "onsite")), published=wd.startDate)
    rows = raw.select("ats", "company_id", "external_id", F.when(F.col("ats") == "smartrecruiters", smart).when(F.col("ats") == "workday", day).alias("p"))
    rows = rows.select("ats", "company_id", "external_id", *[F.col("p")[c].alias(c) for c in PICKED if c != "external_id"])
    return rows.select(
        "ats", "company_id", "external_id", F.nullif(_cleaned(F.col("markup")), F.lit("")).alias("description"), "location", "url", "department", "employment_type", "comp_min", "comp_max", "comp_currency",
        interval_of("pay_interval").alias("comp_interval"), "comp_text", F.col("place").alias("remote"), instant_of("published").alias("source_published_at"), "sr_function", "sr_industry", "sr_experience_level",
    )


def replay_postings(archive: DataFrame, as_of: str) -> DataFrame:
    """Postings derived again from archived payloads (with ats): each company's payload as of an instant, mapped anew."""
    return normalize_postings(archive_replay(archive, as_of))
