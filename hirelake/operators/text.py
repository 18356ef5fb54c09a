"""Table jobs over text: keys, shards, HTML cleaning, labelled fields, pay, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the postings' source counts it.
SPACE = r"[ \t\n\x0B\f\r   -     　﻿]+"


def _norm(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), SPACE, " "))


def dedup_keys(postings: DataFrame) -> DataFrame:
    """A role key of title and location, and a content key of the text (none for no text)."""
    role = F.md5(F.concat_ws("|", _norm("title"), _norm("location")))
    return postings.withColumn("role_key", role).withColumn("content_key", F.when(F.col("text") != "", F.md5("text")))


def shard_assign(companies: DataFrame, n: int = 60) -> DataFrame:
    """``shard``: a stable bucket of each id from 0 to n - 1; null for null."""
    return companies.withColumn("shard", (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("int") % n).cast("int"))


def shard_ranges(companies: DataFrame, shards: int, buckets: int = 60) -> DataFrame:
    """``owner``: which of so many shards has each company's bucket; shard i has those from i * buckets / shards on.

    Ranges meet without a gap or an overlap, so every company with an id has one owner; more shards than buckets leave
    some without any.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    # The last i with floor(i * buckets / shards) <= bucket.
    owner = F.floor(((F.col("shard") + 1) * shards - 1) / buckets)
    return shard_assign(companies, buckets).withColumn("owner", owner.cast("int"))


#: Entities decoded before and after tags go, the ampersand last; and elements whose end is a line break.
ENTITIES = [
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"),
    ("rsquo", "’"), ("lsquo", "‘"), ("rdquo", "”"), ("ldquo", "“"), ("trade", "™"), ("copy", "©"), ("reg", "®"), ("amp", "&"),
]
BLOCKS = "p|div|li|h[1-6]|tr|td|th|section|article"


def clean_html(col: Column | str) -> Column:
    """Text of markup: scripts and styles go, ends of blocks are line breaks, other tags vanish, entities are decoded.

    Numbered entities and image or link brackets are a blank; lines are trimmed, and at most one of them is blank in a
    row. Null stays null.
    """
    out = F.col(col) if isinstance(col, str) else col

    def decoded(text: Column) -> Column:
        for name, char in ENTITIES:
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
        return text

    out = F.regexp_replace(decoded(out), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<\s*br\s*/?\s*>", "\n")
    out = F.regexp_replace(out, rf"(?i)</\s*(?:{BLOCKS})\s*>", "\n")
    out = decoded(F.regexp_replace(out, r"<[^>]+>", ""))
    out = F.regexp_replace(out, r"&#(?:x[0-9a-fA-F]+|[0-9]+);", " ")
    out = F.regexp_replace(out, r"(?i)\[image:[^\]]*\]", " ")
    out = F.regexp_replace(out, r"\[https?://[^\]]+\]", " ")
    out = F.regexp_replace(F.translate(out, "\u00a0", " "), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def clean_corpus(pages: DataFrame, col: str = "html") -> DataFrame:
    """``clean`` text of each row, with the lengths before and after; null for null."""
    return pages.withColumn("clean", clean_html(col)).withColumn("before", F.length(col)).withColumn("after", F.length("clean"))


def labelled_fields(docs: DataFrame, key: str, col: str) -> DataFrame:
    """``Label: value`` lines as (key, label, value); empty and unknown values go, and the last of a label wins."""
    lines = docs.select(key, F.posexplode(F.split(col, "\n")).alias("pos", "line"))
    parts = lines.select(key, "pos", F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z ]+):", 1))).alias("label"), F.trim(F.regexp_extract("line", r"^[A-Za-z ]+:(.*)$", 1)).alias("value"))
    good = parts.where((F.col("label") != "") & (F.col("value") != "") & ~F.lower("value").isin("unknown", "n/a"))
    return good.groupBy(key, "label").agg(F.max_by("value", "pos").alias("value"))


def skill_index(docs: DataFrame, key: str, col: str, stop: list[str] | None = None) -> DataFrame:
    """(skill, key) of every listed skill of two characters or more."""
    skills = docs.select(key, F.explode(F.split(F.col(col), r"[,()/]")).alias("s")).select(key, F.trim(F.lower("s")).alias("skill"))
    return skills.where((F.length("skill") >= 2) & ~F.col("skill").isin(stop or ["and", "or"])).distinct()


#: Where each board's address names a tenant, and names in that place that are none.
SLUG_PATTERNS = {
    "greenhouse": r"(?:boards|job-boards)\.greenhouse\.io/([a-z0-9][a-z0-9-_]{1,60})",
    "lever": r"jobs\.lever\.co/([a-z0-9][a-z0-9-_]{1,60})",
    "ashby": r"jobs\.ashbyhq\.com/([a-z0-9][a-z0-9-_]{1,60})",
    "smartrecruiters": r"(?:careers|jobs)\.smartrecruiters\.com/([a-z0-9][a-z0-9-_]{1,60})",
}
RESERVED_SLUGS = ["embed", "departments", "jobs", "search", "job", "j", "i", "careers", "about", "company", "apply", "static", "assets", "api", "login"]


def slug_mentions(corpus: DataFrame, col: str, patterns: dict[str, str] | None = None, reserved: list[str] | None = None) -> DataFrame:
    """(ats, slug, hits): every tenant that texts or addresses mention, in lower case, and how often; reserved names go."""
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    named = lambda ats: lambda s: F.struct(F.lit(ats).alias("ats"), s.alias("slug"))
    found = [F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), named(ats)) for ats, pattern in (patterns or SLUG_PATTERNS).items()]
    rows = corpus.select(F.explode(F.concat(*found)).alias("m")).select("m.ats", "m.slug")
    return rows.where(~F.col("slug").isin(RESERVED_SLUGS if reserved is None else reserved)).groupBy("ats", "slug").agg(F.count("*").alias("hits"))


def host_mentions(pages: DataFrame, url: str = "url") -> DataFrame:
    """Hosts that a corpus of URLs mentions, with how often; www. goes."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)), r"^www\.", "")
    return pages.select(host.alias("slug")).where("slug != ''").groupBy("slug").agg(F.count("*").alias("hits"))


#: Endings that a renamed tenant takes on, and those that it may lose.
APPENDED = ["labs", "hq", "careers", "jobs", "inc", "hr", "global", "ai", "io"]
STRIPPED = ["labs", "hq", "inc", "io", "ai", "app", "team", "careers", "jobs", "global", "official", "group", "tech", "hr"]


def slug_variants(companies: DataFrame, key: str = "company_id") -> DataFrame:
    """(key, variant, place): names that a company's slug may have moved to, the likeliest first, each once."""
    slug = F.col("slug")
    tried = F.array(*[F.concat(slug, F.lit(f"-{x}")) for x in APPENDED], F.regexp_replace(slug, f"-({'|'.join(STRIPPED)})$", ""), F.replace(slug, F.lit("-"), F.lit("")))
    good = F.array_distinct(F.filter(tried, lambda v: (v != slug) & (v != "")))
    return companies.where("slug IS NOT NULL AND slug != ''").select(key, F.posexplode(good).alias("place", "variant"))


#: Currency signs in the order that they are looked for, codes, the forms of an interval, how a number looks,
#: and what counts as white space. A word's edge is that of ASCII letters, digits and _.
SIGNS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY")]
CODES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY", "INR", "SGD", "CHF", "SEK", "NOK", "DKK"]
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_OPEN, _SHUT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
HOURLY = rf"(?i)/{BLANK}*hr|{_OPEN}per{BLANK}+hour|{_OPEN}hourly{_SHUT}"
YEARLY = rf"(?i){_OPEN}per{BLANK}+year|{_OPEN}annual|(?<=[A-Za-z0-9_])/{BLANK}*yr"
NUMBER = rf"(\d[\d,.]*){BLANK}*([KkMm])?"


def compensation(col: str) -> list[Column]:
    """comp_min, comp_max, comp_currency, comp_interval of a pay text; all null for none and blank ones.

    The first two numbers are the range. Any sign decides the currency before any code, and of codes the first in the text.
    Without words for it, numbers all under 1,000 are hourly. Where the first number is over twice the second it is no
    range: both are null, currency and interval stay.
    """
    text = F.col(col)
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    scale = lambda u: F.when(F.lower(u) == "k", 1e3).when(F.lower(u) == "m", 1e6).otherwise(1.0)
    values = F.zip_with(numbers, units, lambda n, u: F.regexp_replace(n, ",", "").try_cast("double") * scale(u))
    values = F.filter(values, lambda v: v.isNotNull())
    low, high = F.get(values, F.lit(0)), F.coalesce(F.get(values, F.lit(1)), F.get(values, F.lit(0)))
    sane = low <= high * 2
    currency = F.nullif(F.upper(F.regexp_extract(text, f"(?i){_OPEN}({'|'.join(CODES)}){_SHUT}", 1)), F.lit(""))
    for sign, code in reversed(SIGNS):
        currency = F.when(F.contains(text, F.lit(sign)), code).otherwise(currency)
    small = low.isNotNull() & F.forall(values, lambda v: v < 1000)
    interval = F.when(text.rlike(HOURLY), "hour").when(text.rlike(YEARLY), "year").when(small, "hour")
    return [F.when(sane, low).alias("comp_min"), F.when(sane, high).alias("comp_max"), currency.alias("comp_currency"), interval.alias("comp_interval")]


def compensation_table(postings: DataFrame, key: str, col: str) -> DataFrame:
    """Each row's key, pay text and what ``compensation`` reads from it."""
    return postings.select(key, F.col(col).alias("text"), *compensation(col))


#: Families of titles with whether they are a target and the words that tell them; the first that matches
#: decides. Words begin at a word's start and need not end at its end.
TITLE_RULES = [
    ("service_hospitality", False, r"dishwasher|busser|barista|bartender|bar ?back|waiter|waitress|wait\s?staff|\bserver\b|host(ess)?|line cook|prep cook|\bcook\b|\bchef\b|kitchen|catering|restaurant|food service|food (?:&|and) beverage|hospitality|housekeep|room attendant|valet|concierge|crew member|fast food|drive.?thru|spa therap"),
    ("retail", False, r"cashier|sales associate|retail|store associate|store manager|shop assistant|merchandiser|stock(er| associate| clerk)|bagger|checkout|vendeur|vendeuse|sales assistant|key ?holder|department manager, store"),
    ("clinical_healthcare", False, r"care assistant|caregiver|carer|\bcna\b|nursing assistant|home health|dental (assistant|nurse|hygienist)|dentist|chirurgien|medical assistant|phlebotom|physical therap|occupational therap|veterinar|\bvet\b|registered nurse|\brn\b|\blpn\b|\bcma\b|patient care|pharmacy technician|midwife|paramedic|\bemt\b|behavio.?r(al)? (health )?technician|\brbt\b|\baba\b (therap|provider)|direct support professional|optician|esthetician|massage therap|practical nurse|mental health therap|diversional therap"),
    ("skilled_trades", False, r"electrician|plumber|\bhvac\b|automotive|\bmechanic\b|welder|machinist|carpenter|painter|roofer|locksmith|appliance (repair|technician)|field service (technician|tech)|maintenance (technician|worker)|installer|lineman|millwright|fabricator|tire technician|diesel|auto body|reconditioning"),
    ("manual_labor", False, r"warehouse|forklift|laborer|labourer|order picker|\bpicker\b|\bpacker\b|loader|mover|\bdriver\b|delivery|courier|chauffeur|landscap|groundskeep|cleaner|cleaning|janitor|custodian|sanitation|production (worker|operative|associate)|assembler|machine operator|general labor|farm|harvest|distribution (technician|associate|worker)"),
    ("security_guard", False, r"security (guard|officer)|loss prevention|patrol officer|door supervisor|bouncer|gate ?keeper"),
    ("education_childcare", False, r"childcare|child care|\bnanny\b|babysitt|preschool|daycare|teaching assistant|paraprofessional|substitute teacher|early years|after.?school"),
    ("software_engineering", True, r"software (engineer|developer)|développeur|\bdeveloper\b|programmer|\bsde\b|\bswe\b|full.?stack|back.?end|front.?end|web developer|mobile (developer|engineer)|\bios\b|android (developer|engineer)|embedded (engineer|software)|firmware|game (developer|engineer)|qa (engineer|automation)|\bsdet\b|automation engineer|engineering (manager|lead)|staff engineer|principal engineer|founding engineer|product engineer|software architect"),
    ("data_ai", True, r"data scien|data engineer|machine learning|\bml\b ?(engineer|scientist|ops)|\bai\b ?(engineer|scientist|researcher)|mlops|deep learning|\bnlp\b|computer vision|research scientist|applied scientist|analytics engineer|business intelligence|\bbi\b (developer|analyst|engineer)|data analyst|quantitative (analyst|research)|decision scien"),
    ("it_infrastructure", True, r"devops|\bsre\b|site reliability|platform engineer|cloud (engineer|architect|infrastructure)|infrastructure engineer|systems? engineer|system administrator|sysadmin|network (engineer|administrator)|database administrator|\bdba\b|it (support|administrator|manager|specialist)|help ?desk|service desk|desktop support|solutions architect|technical support engineer"),
    ("security", True, r"security engineer|cyber.?security|information security|infosec|appsec|application security|soc analyst|penetration test|pentest|security (analyst|architect|operations)|threat (intelligence|hunting)|grc analyst"),
    ("product", True, r"product manager|product owner|technical program manager|\btpm\b|group product manager|head of product|product operations"),
    ("design", True, r"\bux\b|\bui\b|product designer|ux researcher|ux/ui|interaction designer|visual designer|design (lead|manager|director)|graphic designer|web designer|design systems|motion designer|brand designer"),
    ("finance", True, r"financial analyst|fp&a|\bcontroller\b|accountant|accounting (manager|specialist)|investment (analyst|banking|associate)|equity research|portfolio manager|actuar|treasury (analyst|manager)|tax (manager|analyst|accountant)|auditor|financial (controller|planning)"),
    ("sales", True, r"account executive|\bae\b|sales (engineer|representative|rep|manager|director|specialist)|business development (manager|representative|rep)|\bbdr\b|\bsdr\b|account manager|solutions (engineer|consultant|architect)|sales development|enterprise sales|inside sales|partnerships? manager|customer success manager"),
    ("marketing", True, r"marketing (manager|specialist|director|coordinator|lead)|growth (manager|marketer|lead)|\bseo\b|content (marketer|strategist|manager)|brand (manager|strategist)|demand generation|product marketing|communications manager|public relations|social media (manager|specialist)|digital marketing|performance marketing|lifecycle marketing"),
    ("consulting", True, r"management consult|strategy (consultant|manager|associate)|\bconsultant\b, (technology|management|strategy)|associate consultant|engagement manager|implementation consultant"),
    ("legal", True, r"attorney|lawyer|legal counsel|general counsel|corporate counsel|\bparalegal\b|compliance (officer|manager|analyst)"),
    ("hr_recruiting", True, r"recruiter|talent acquisition|technical recruiter|people (operations|partner)|\bhr\b (manager|business partner|generalist)|human resources (manager|business partner)"),
    ("executive_leadership", True, r"chief (executive|technology|financial|operating|product|marketing|information|revenue|data|people) officer|\bceo\b|\bcto\b|\bcfo\b|\bcoo\b|\bcpo\b|\bcmo\b|\bcio\b|\bciso\b|\bvp\b|vice president|\bsvp\b|\bevp\b|head of (engineering|product|data|design|marketing|sales|growth|operations|finance|revenue|security)"),
]
#: Levels and the words that tell them, the first that matches.
LEVEL_RULES = [
    ("intern", r"intern|internship|co.?op|trainee|apprentice|working student|werkstudent|graduate (program|scheme|analyst)|new grad|early career|placement student"),
    ("exec", r"chief|\bceo\b|\bcto\b|\bcfo\b|\bcoo\b|\bcpo\b|\bcmo\b|\bcio\b|\bciso\b|president|\bvp\b|vice president|\bsvp\b|\bevp\b|\bpartner\b"),
    ("director", r"director|head of"),
    ("manager", r"manager|\blead\b|principal|staff"),
    ("senior", r"senior|\bsr\.?\b|\biii\b|\biv\b"),
    ("junior", r"junior|\bjr\.?\b|entry.level|\bi\b|\bii\b|associate"),
]
#: Families of an employer's departments, words of a title that these never decide, and levels of experience.
FUNCTION_FAMILIES = {"production": "manual_labor", "manufacturing": "manual_labor", "supply chain": "manual_labor", "warehouse": "manual_labor", "transportation": "manual_labor", "health care provider": "clinical_healthcare", "skilled labor trades": "skilled_trades", "restaurant food service": "service_hospitality", "retail": "retail"}
PROFESSIONS = r"manager|engineer|analyst|scientist|developer|designer|architect|consultant|accountant|counsel|attorney|controller|comptroller|recruiter|director|programmer|administrator|economist|strateg"
EXPERIENCE_LEVELS = {"internship": "intern", "entry level": "junior", "associate": "junior", "mid senior level": "senior", "director": "director", "executive": "exec"}


def _words(pattern: str) -> str:
    return rf"(?i)\b(?:{pattern})"


def _mapped(value: Column, table: dict[str, str]) -> Column:
    """What a table has for a value's words, whatever is between them."""
    key = F.trim(F.regexp_replace(F.lower(value), "[^a-z]+", " "))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def tag_titles(postings: DataFrame, rules: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    """Verdicts of titles: tag_family, tag_target, tag_seniority, tag_confidence (high, low) and tag_by.

    A title's own words decide (tag_by "rules"). Where they say nothing, a department (column org_function, if there is
    one) may tell that it is no target, unless the title names a profession ("sr_function"); else it stays open ("low").
    Experience (column experience) fills a level that the title doesn't give. Distinct titles are judged once and joined
    back; null and blank ones are open.
    """
    given = [c for c in ("title", "org_function", "experience") if c in postings.columns]
    column = lambda c: F.col(c) if c in given else F.lit(None).cast("string")
    title = F.trim(F.coalesce("title", F.lit("")))
    family, target, level = F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for name, wanted, pattern in reversed(TITLE_RULES if rules is None else rules):
        family, target = F.when(title.rlike(_words(pattern)), name).otherwise(family), F.when(title.rlike(_words(pattern)), wanted).otherwise(target)
    for name, pattern in reversed(LEVEL_RULES):
        level = F.when(title.rlike(_words(pattern)), name).otherwise(level)
    judged = postings.select(*given).distinct().select(*given, family.alias("_family"), target.alias("_target"), F.coalesce(level, _mapped(column("experience"), EXPERIENCE_LEVELS)).alias("tag_seniority"), F.when(~title.rlike(_words(PROFESSIONS)), _mapped(column("org_function"), FUNCTION_FAMILIES)).alias("_prior"))
    told = F.col("_target").isNotNull()
    guessed = F.col("_prior").isNotNull()
    verdicts = judged.select(
        *[F.col(c).alias(f"_{c}") for c in given],
        F.coalesce("_family", "_prior").alias("tag_family"), F.when(told, F.col("_target")).when(guessed, False).alias("tag_target"), "tag_seniority",
        F.when(told | guessed, "high").otherwise("low").alias("tag_confidence"), F.when(told, "rules").when(guessed, "sr_function").otherwise("low").alias("tag_by"),
    )
    same = F.lit(True)
    for c in given:
        same = same & postings[c].eqNullSafe(verdicts[f"_{c}"])
    return postings.join(verdicts, same, "left").drop(*[f"_{c}" for c in given])


def tag_backfill(jobs: DataFrame, tags: DataFrame) -> DataFrame:
    """Writes confident verdicts to unclassified rows only, with who gave them."""
    good = tags.where("tag_confidence = 'high' AND tag_target IS NOT NULL AND tag_family IS NOT NULL")
    rows = jobs.join(good.select("id", "tag_family", "tag_target", "tag_seniority", "tag_by").dropDuplicates(["id"]), "id", "left")
    open_row = F.col("job_family").isNull() & F.col("is_target").isNull() & F.col("tag_target").isNotNull()
    put = lambda tag, old: F.when(open_row, F.col(tag)).otherwise(F.col(old)).alias(old)
    return rows.select("id", put("tag_family", "job_family"), put("tag_target", "is_target"), put("tag_seniority", "seniority"), F.when(open_row, F.col("tag_by")).alias("classified_by"))


def tag_summary(tags: DataFrame) -> DataFrame:
    """How many rows each verdict has."""
    return tags.groupBy("tag_family", "tag_target", "tag_confidence", "tag_by").agg(F.count("*").alias("n"))


#: A title's level as an embedder is told it, and signs of currencies.
TITLE_LEVELS = [("intern", r"\b(intern|internship)\b"), ("vp", r"\b(vp|vice president)\b"), ("director", r"\bdirector\b"), ("principal", r"\bprincipal\b"), ("staff", r"\bstaff\b"), ("senior", r"\b(senior|sr\.?|snr\.?)\b"), ("lead", r"\blead\b"), ("junior", r"\b(junior|jr\.?)\b")]
PAY_SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}
DESCRIPTION_CHARS = 1500


def pay_phrase(low: Column, high: Column, currency: Column, interval: Column, text: Column) -> Column:
    """Pay as a phrase ("$160K – $220K /year"), or the board's own text where there are no numbers."""
    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PAY_SIGNS.items() for x in pair]), currency), F.lit(""))
    number = lambda n: F.concat(sign, F.when(n >= 1000, F.concat(F.round(n / 1000, 0).cast("long").cast("string"), F.lit("K"))).otherwise(F.round(n, 0).cast("long").cast("string")))
    span = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(number(low), F.lit(" – "), number(high))).otherwise(number(F.coalesce(low, high)))
    code = F.when(sign == "", F.coalesce(F.concat(currency, F.lit(" ")), F.lit(""))).otherwise("")
    phrase = F.concat(code, span, F.coalesce(F.concat(F.lit(" /"), interval), F.lit("")))
    return F.when(F.coalesce(low, high).isNotNull(), phrase).otherwise(F.nullif(text, F.lit("")))


def embedding_input(jobs: DataFrame) -> DataFrame:
    """id, input, tokens: one text for each posting, and its estimated tokens (a quarter of its characters).

    Title, lines of what is known, and the summary or else the description, cut after 1,500 characters. Columns that
    the table lacks count as null; null and empty parts leave no line.
    """
    types = {"comp_min": "double", "comp_max": "double"}
    column = lambda c: F.col(c).cast(types.get(c, "string")) if c in jobs.columns else F.lit(None).cast(types.get(c, "string"))
    level = F.lit(None).cast("string")
    for name, pattern in reversed(TITLE_LEVELS):
        level = F.when(F.lower("title").rlike(pattern), name).otherwise(level)
    pay = pay_phrase(column("comp_min"), column("comp_max"), column("comp_currency"), column("comp_interval"), column("comp_text"))
    named = [("Seniority", level), ("Workplace", column("remote")), ("Compensation", pay), ("Employment type", column("employment_type")), ("Department", column("department")), ("Location", column("location"))]
    signals = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.nullif(value, F.lit(""))) for name, value in named])
    description = column("description")
    cut = F.when(F.length(description) > DESCRIPTION_CHARS, F.concat(F.substring(description, 1, DESCRIPTION_CHARS), F.lit("…"))).otherwise(description)
    body = F.coalesce(F.nullif(column("description_summary"), F.lit("")), F.nullif(cut, F.lit("")))
    return jobs.select("id", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.nullif(signals, F.lit("")), body).alias("input")).withColumn("tokens", F.ceil(F.length("input") / 4))


def token_cost_estimate(texts: DataFrame, col: str, price_per_million: float) -> DataFrame:
    """Tokens of all texts, at four characters each and rounded up by text, and what they cost; null texts count nothing."""
    tokens = F.sum(F.ceil(F.length(col) / 4))
    return texts.agg(tokens.alias("tokens"), F.round(tokens * price_per_million / 1e6, 6).alias("cost"))
