"""Payloads of each board, with what is missing, of another shape or no JSON."""

import datetime as dt
import html
import json

import pytest

from hirelake.sources.postings import embedded_json_extract, normalize_details, normalize_postings, rejected_payloads


def page(document):
    return f'<div id="app" data-page="{html.escape(json.dumps(document)).replace("&#x27;", "&#39;")}"></div>'


BODIES = {
    "greenhouse": json.dumps({"jobs": [{"id": 7, "title": "Dev", "location": {"name": "Remote (US)"}, "absolute_url": "https://b/7", "departments": [{"name": "R&D"}], "content": "&lt;p&gt;A &amp;amp; B&lt;/p&gt;", "updated_at": "2024-01-02T03:04:05-05:00"}, {"id": 8}]}),
    "ashby": json.dumps({"jobs": [{"id": "a", "title": "T", "isRemote": False, "location": "hybrid, Rome", "descriptionPlain": "", "descriptionHtml": "<p>x</p>", "publishedAt": "2024-01-02T00:00:00Z", "compensation": {"compensationTiers": [{"tierSummary": "sum", "components": [{"compensationType": "EquityPercentage"}, {"compensationType": "Salary", "minValue": 1.5, "maxValue": 2, "currencyCode": "EUR", "interval": "1 YEAR"}]}]}}]}),
    "lever": json.dumps([{"id": "l", "text": "L", "categories": {"commitment": "Full"}, "applyUrl": "u", "descriptionPlain": "one   two", "lists": [{"text": "Do", "content": "<li>a</li>"}, {}], "salaryRange": {"min": 90000, "max": 120000.5, "currency": "USD", "interval": "per-year-salary"}, "workplaceType": "on-site", "createdAt": 1704067200000}]),
    "smartrecruiters": json.dumps({"content": [{"uuid": "q", "id": "", "name": "N", "location": {"city": "Oslo", "country": "no", "remote": True}, "companyName": "C", "function": {"label": "IT"}}]}),
    "workatastartup": page({"props": {"company": {"jobs": [{"id": 5, "title": "Eng & \"co\"", "salaryRange": "$120K - $180K", "remote": None, "location": "SF"}]}}}),
    "workday": json.dumps({"total": 1, "jobPostings": [{"title": "W", "locationsText": "Berlin", "externalPath": "/job/1"}, {"bulletFields": ["", "JR1"]}], "_wd": {"host": "h", "site": "s"}}),
}


@pytest.fixture(scope="module")
def rows(spark):
    raw = [(a, i, b) for i, (a, b) in enumerate(BODIES.items())]
    raw += [(a, 50, b) for a in BODIES for b in ("{}", "[]", "", None, "no json", '{"jobs": 3}')] + [(None, 51, "{}"), ("other", 52, "{}")]
    got = normalize_postings(spark.createDataFrame(raw, "ats STRING, company_id LONG, body STRING")).collect()
    assert {r.company_id for r in got} == set(range(6))
    return {r.external_id: r for r in got}


def test_each_board(rows):
    g = rows["7"]
    assert (g.title, g.location, g.url, g.department, g.remote, g.source_updated_at) == ("Dev", "Remote (US)", "https://b/7", "R&D", "remote", dt.datetime(2024, 1, 2, 8, 4, 5))
    assert g.description == "A & B"
    bare = rows["8"]
    assert (bare.title, bare.location, bare.url, bare.department, bare.description, bare.remote) == ("", "", "", None, None, None)
    a = rows["a"]
    assert (a.comp_min, a.comp_max, a.comp_currency, a.comp_interval, a.comp_text, a.remote, a.description) == (1.5, 2.0, "EUR", "year", "sum", "hybrid", "x")
    v = rows["l"]
    assert (v.url, v.employment_type, v.comp_text, v.comp_interval, v.remote, v.source_published_at) == ("u", "Full", "90,000 – 120,000.5", "year", "onsite", dt.datetime(2024, 1, 1))
    assert v.description == "one two\n\nDo\n\na"
    s = rows["q"]
    assert (s.location, s.url, s.remote, s.sr_function) == ("Oslo, no", "https://careers.smartrecruiters.com/C", "remote", "IT")
    w = rows["5"]
    assert (w.title, w.url, w.comp_min, w.comp_max, w.comp_currency, w.comp_text, w.remote) == ('Eng & "co"', "https://www.workatastartup.com/jobs/5", 120000.0, 180000.0, "USD", "$120K - $180K", None)
    assert rows["/job/1"].url == "https://h/s/job/1" and rows["JR1"].url == ""


def test_rejects(spark):
    raw = [("lever", 1, "[]"), ("lever", 2, "no json"), ("workatastartup", 3, "<html></html>"), ("workatastartup", 4, page({})), ("other", 5, "{}"), (None, 6, "{}"), ("ashby", 7, None)]
    got = rejected_payloads(spark.createDataFrame(raw, "ats STRING, company_id LONG, body STRING"))
    assert sorted(r.company_id for r in got.collect()) == [2, 3, 5, 6, 7]


def test_details(spark):
    smart = {"jobAd": {"sections": {"jobDescription": {"text": "<p>a</p>"}, "qualifications": {"text": "b"}}}, "compensation": {"min": 10, "currency": "EUR", "period": "MONTHLY"}, "location": {"city": "Oslo"}, "releasedDate": "2024-01-01T00:00:00Z"}
    day = {"jobPostingInfo": {"location": "Remote - US", "jobDescription": "<p>d</p>", "timeType": "Full time", "startDate": "2024-02-01"}}
    raw = [("smartrecruiters", 1, "x", json.dumps(smart)), ("workday", 2, "y", json.dumps(day)), ("workday", 3, "z", "no json"), ("smartrecruiters", 4, "w", None)]
    got = {r.external_id: r for r in normalize_details(spark.createDataFrame(raw, "ats STRING, company_id LONG, external_id STRING, body STRING")).collect()}
    assert (got["x"].description, got["x"].comp_text, got["x"].comp_interval, got["x"].remote, got["x"].location) == ("a\n\nb", "10 EUR", "month", "onsite", "Oslo")
    assert (got["y"].description, got["y"].remote, got["y"].employment_type, got["y"].source_published_at) == ("d", "remote", "Full time", dt.datetime(2024, 2, 1))
    assert got["z"].description is None and got["z"].remote is None and got["w"].remote is None


def test_embedded_json(spark):
    got = embedded_json_extract(spark.createDataFrame([(page({"a": "<&amp;quot;'>"}),), ("<p>",), (None,)], "html STRING"), "STRUCT<a: STRING>").collect()
    assert [r.parsed and r.parsed.a for r in got] == ["<&amp;quot;'>", None, None]
