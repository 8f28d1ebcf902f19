"""Page-corpus jobs: SEO fields, links, structure, blocks, quality, verdicts, captcha census, duplicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.functions import urls as U
from catalogwatch.functions.values import any_of, contains_any, count_hits, in_order, ratio, strip
from catalogwatch.operators import html_table as H
from catalogwatch.operators.timeline import DAY, trailing_rows

# Phrases and patterns of blocked pages.
BLOCK_PHRASES = (
    "access denied", "blocked", "captcha", "rate limit", "заблокирован", "доступ запрещен", "капча", "cloudflare",
    "ddos protection", "security check", "forbidden", "unauthorized", "too many requests", "service unavailable",
    "temporarily unavailable",
)
CAPTCHA_PATTERNS = (
    "captcha", "recaptcha", "hcaptcha", "prove you are human", "robot verification", "security verification",
    "verify.*human", "solve.*challenge", "i.*not.*robot",
)
RATE_PATTERNS = (
    "rate limit", "too many requests", "request limit", "throttled", "slow down", "try again later", "превышен лимит",
    "слишком много запросов",
)
BOT_PATTERNS = (
    "bot detected", "automated traffic", "suspicious activity", "bot.*block", "anti.*bot", "robot.*detect", "обнаружен бот",
    "автоматический трафик",
)
STATUS_PHRASES = (
    "403 forbidden", "429 too many requests", "503 service unavailable", "error 403", "error 429", "error 503", "status: 403",
    "status: 429",
)
CAPTCHA_SERVICES = ("recaptcha", "hcaptcha", "funcaptcha", "geetest", "cloudflare", "turnstile")
GUARD_PHRASES = (
    "ddos-guard", "checking your browser", "attention required", "cloudflare", "please enable javascript",
    'meta name="robots" content="noindex"', "adblock-blocker", "/protect", "var adb = 1",
)
RATE_HEADERS = (
    "x-ratelimit-remaining", "retry-after", "x-rate-limit", "x-ratelimit-limit", "ratelimit-remaining", "rate-limit-remaining",
)
RATE_PHRASES = ("rate limit", "too many requests", "слишком много запросов", "превышен лимит", "throttled", "slow down")
CHALLENGES = (
    ("cloudflare", ("cloudflare", "cf-browser-verification", "cf-ray")),
    ("ddos_guard", ("ddos-guard", "ddosguard", "checking your browser")),
    ("captcha", ("captcha", "recaptcha", "hcaptcha")),
    ("bot_detection", ("bot detected", "automated traffic", "suspicious activity")),
    ("rate_limiting", ("rate limited", "too many requests", "slow down")),
    ("js_redirect", ("window.location", "document.location", "location.href")),
    ("loading_screen", ("loading...", "please wait", "redirecting")),
)
ERROR_PHRASES = (
    "error", "exception", "failed", "not found", "unavailable", "ошибка", "исключение", "не найдено", "недоступно",
)
ERROR_PATTERNS = (
    "access denied", "blocked", "forbidden", "rate limit", "too many requests", "captcha", "verification required",
    "bot detected", "suspicious activity", "service unavailable", "temporarily unavailable", "заблокирован",
    "доступ запрещен", r"ошибка \d+", r"error \d+", r"http \d{3}",
)
PLACEHOLDER_PATTERN = (
    "page not found|temporarily unavailable|maintenance|coming soon|under construction|please try again|service unavailable"
)
BLOCK_PAGE_PATTERN = "(?i)error|404|not found|blocked"
SCRIPT_SIGNS = ("<script", "react", "angular", "vue", "fetch(")
SEMANTIC_TAGS = ("header", "nav", "main", "article", "section", "aside", "footer")
CONTENT_TAGS = ("h1", "h2", "h3", "p", "div", "span")
CAPTCHA_TYPES = (
    ("recaptcha_v3", (r"www\.google\.com/recaptcha/api\.js\?render=([^&\s\"]+)", r"grecaptcha\.execute", r"data-action=\"([^\"]+)\""), 0.9),
    ("recaptcha_v2", (r"www\.google\.com/recaptcha/api\.js", r"www\.google\.com/recaptcha/api/challenge", r"data-sitekey=\"([^\"]+)\"",
                      r"grecaptcha\.render", r"<div[^>]*class=\"g-recaptcha\""), 0.8),
    ("hcaptcha", (r"hcaptcha\.com/1/api\.js", r"data-sitekey=\"([^\"]+)\"", r"<div[^>]*class=\"h-captcha\"", r"hcaptcha\.render"), 0.8),
    ("image_captcha", (r"<img[^>]*captcha[^>]*>", r"captcha\.jpg|captcha\.png|captcha\.gif", r"verification.*image", r"security.*code"), 0.6),
)
# Limits of the quality and silent-block scores.
MIN_LENGTH, QUALITY_LIMIT, HARD_LIMIT, MIN_RATIO = 1000, 0.7, 0.5, 0.3
REQUIRED_TAGS = ("title", "h1")


def _one_of(c: Column, patterns) -> Column:
    """Does any of the patterns occur? ``c`` is lower-case text.

    Plain phrases are substring tests, phrases joined by ``.*`` ordered substring tests; only what
    is left needs a regular expression.
    """
    plain = [p for p in patterns if re.fullmatch(r"[\w\s-]+", p)]
    ordered = [p.split(".*") for p in patterns if ".*" in p and all(re.fullmatch(r"[\w\s-]+", w) for w in p.split(".*"))]
    rest = [p for p in patterns if p not in plain and p.split(".*") not in ordered]
    tests = [c.contains(p) for p in plain] + [in_order(c, *words) for words in ordered]
    if rest:
        tests.append(c.rlike("|".join(f"(?:{p})" for p in rest)))
    return any_of(tests)


# --- SEO, links, structure -------------------------------------------------------------------------


def seo_fields(parsed: DataFrame, *keep: str) -> DataFrame:
    """SEO columns of parsed pages."""
    link = lambda e, rel: (e["tag"] == "link") & F.lower(H.attr(e, "rel")).contains(rel)
    canonical = H.first_of(F.filter("elements", lambda e: link(e, "canonical")))
    langs = F.transform(
        F.filter("elements", lambda e: link(e, "alternate") & H.attr(e, "hreflang").isNotNull()),
        lambda e: F.concat_ws("|", H.attr(e, "hreflang"), H.attr(e, "href")),
    )
    alts = F.filter(F.transform(H.every("img"), lambda e: H.trimmed(F.coalesce(H.attr(e, "alt"), F.lit("")))), lambda a: a != "")
    og, tw = (lambda n: F.coalesce(H.meta(f"og:{n}", "property"), H.meta(f"og:{n}"))), (
        lambda n: F.coalesce(H.meta(f"twitter:{n}"), H.meta(f"twitter:{n}", "property"))
    )
    return parsed.select(
        *keep,
        H.first_text_of("title").alias("title"),
        H.meta("description").alias("meta_description"),
        H.first_text_of("h1").alias("h1"),
        og("title").alias("og_title"),
        og("description").alias("og_description"),
        og("image").alias("og_image"),
        tw("title").alias("twitter_title"),
        tw("description").alias("twitter_description"),
        F.nullif(H.trimmed(H.attr(canonical, "href")), F.lit("")).alias("canonical"),
        H.meta("robots").alias("robots"),
        F.nullif(F.array_join(langs, "|"), F.lit("")).alias("hreflang"),
        F.nullif(F.array_join(alts, "|"), F.lit("")).alias("images_alt_joined"),
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html", *keep: str) -> DataFrame:
    """Absolute targets of the page's links, one row each: ``a`` elements of the parsed page, fragments cut off."""
    parsed = H.parse_pages(pages.select(*keep, F.col(url).alias("page_url"), F.col(html).alias("_html")), "_html")
    hrefs = F.transform(F.filter(H.every("a"), lambda e: H.attr(e, "href").isNotNull()), lambda e: strip(F.substring_index(H.attr(e, "href"), "#", 1)))
    rows = parsed.select(*keep, "page_url", F.posexplode(F.filter(hrefs, lambda h: h != "")).alias("pos", "href"))
    return rows.withColumn("target", U.resolve_link(F.col("page_url"), F.col("href"))).where(U.scheme_of(F.col("target")).isin("http", "https"))


def page_structure(parsed: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """Skeleton tags, counts and the 0..100 structure score."""
    parts = {f"has_{t}": H.has(t) for t in ("html", "head", "body", "title")}
    length = F.length(H.page_text())
    a = parsed.select(
        *keep,
        *[c.alias(n) for n, c in parts.items()],
        length.alias("text_length"),
        F.size("elements").alias("element_count"),
        H.count("a").alias("link_count"),
        H.count("img").alias("image_count"),
        H.count("script").alias("script_count"),
        ratio(length, F.length(html)).alias("text_ratio"),
    )
    score = sum((F.when(F.col(n), 25).otherwise(0) for n in parts), F.lit(0))
    return a.withColumn("structure_score", score).withColumn("valid", F.col("structure_score") >= 50)


# --- blocks ------------------------------------------------------------------------------------------


def block_verdict(html: Column) -> dict[str, Column]:
    """Blocked or not, type of the strongest late rule, confidence, number of indicator kinds.

    Later rules overwrite the type: captcha, rate limit, bot detection, http error.
    """
    t = F.lower(html)
    phrases = count_hits(t, BLOCK_PHRASES)
    captcha, rate, bot = _one_of(t, CAPTCHA_PATTERNS), _one_of(t, RATE_PATTERNS), _one_of(t, BOT_PATTERNS)
    status = contains_any(t, STATUS_PHRASES)
    kind = F.when(status, "http_error").when(bot, "bot_detection").when(rate, "rate_limit").when(captcha, "captcha")
    confidence = (
        F.when(captcha, 0.95).when(rate, 0.9).when(bot, 0.85).when(status, 0.8).otherwise(F.least(F.lit(0.8), phrases * 0.2))
    )
    return {
        "blocked": (phrases > 0) | captcha | rate | bot | status,
        "block_type": kind,
        "block_confidence": confidence.cast("double"),
        "block_phrases": phrases,
    }


def challenges(html: Column) -> Column:
    """Sorted kinds of challenge marks on a page."""
    t = F.lower(html)
    marks = [F.when(contains_any(t, words), F.lit(name)) for name, words in CHALLENGES]
    marks.append(F.when(t.rlike(r"<meta[^>]*http-equiv=[\"']?refresh"), F.lit("meta_refresh")))
    marks.append(F.when(t.rlike(r"<form[^>]*\bid=[\"']?[^\"'>]*(?:challenge|captcha|verify)"), F.lit("challenge_form")))
    marks.append(F.when(t.rlike(r"<noscript[^>]*>(?:(?!</noscript)[\s\S])*?javascript"), F.lit("noscript_warning")))
    return F.array_sort(F.array_compact(F.array(*marks)))


def is_guard_page(html: Column) -> Column:
    return F.coalesce(contains_any(F.lower(html), GUARD_PHRASES), F.lit(False))


def is_captcha_page(html: Column) -> Column:
    t = F.lower(html)
    # an element whose class, name or source mentions a captcha contains the word itself
    return F.coalesce(_one_of(t, CAPTCHA_PATTERNS) | contains_any(t, CAPTCHA_SERVICES), F.lit(False))


def is_rate_limited(html: Column, headers: Column | None = None) -> Column:
    """Rate-limit words in the page or rate-limit headers (MAP)."""
    hit = contains_any(F.lower(html), RATE_PHRASES)
    if headers is not None:
        keys = F.transform(F.map_keys(headers), F.lower)
        hit = hit | F.arrays_overlap(keys, F.array(*[F.lit(h) for h in RATE_HEADERS]))
    return F.coalesce(hit, F.lit(False))


def is_script_heavy(html: Column) -> Column:
    """More than three script signs, or more than five script tags.

    The three further signs written in mixed case can never occur in lowered text and are left out.
    """
    t = F.lower(html)
    signs = count_hits(t, SCRIPT_SIGNS)
    tags = F.size(F.split(t, "<script")) - 1
    return (signs > 3) | (tags > 5)


def is_product_page(parsed: bool = True) -> Column:
    """Price mark, option selects of a product form, or an open-graph product."""

    def mark(e: Column) -> Column:
        body = (e["tag"] == "body") & H.class_text(e).contains("single-product")
        form = (e["tag"] == "form") & H.class_text(e).contains("variations_form")
        og = (e["tag"] == "meta") & (H.attr(e, "property") == "og:type") & (H.attr(e, "content") == "product")
        return F.coalesce((H.attr(e, "itemprop") == "price"), F.lit(False)) | F.coalesce(og, F.lit(False)) | body | form

    product_form = F.exists("elements", lambda e: (e["tag"] == "form") & F.coalesce(H.attr(e, "id").startswith("product"), F.lit(False)))
    options = F.exists("elements", lambda e: (e["tag"] == "select") & F.coalesce(H.attr(e, "name").startswith("option"), F.lit(False)))
    return F.exists("elements", mark) | (product_form & options)


def captcha_type(html: Column) -> dict[str, Column]:
    """Kind of captcha on a page, whether a site key is there, confidence (first kind wins)."""
    kind = sure = None
    low = F.lower(html)
    for name, patterns, confidence in CAPTCHA_TYPES:
        hit = _one_of(low, patterns)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        sure = F.when(hit, confidence) if sure is None else sure.when(hit, confidence)
    key = F.when(kind == "recaptcha_v3", F.regexp_extract(html, r"(?i)render=([^&\s\"]+)", 1)).otherwise(
        F.regexp_extract(html, r"(?i)data-sitekey=\"([^\"]+)\"", 1)
    )
    return {
        "captcha_type": kind,
        "has_site_key": (kind != "image_captcha") & (key != ""),
        "captcha_confidence": F.coalesce(sure, F.lit(0.0)),
    }


# --- quality and verdict -------------------------------------------------------------------------------


def _class_or_id(names: str, ids: bool) -> Column:
    def hit(e: Column) -> Column:
        out = H.class_text(e).rlike(names)
        return out | F.coalesce(H.attr(e, "id").rlike(names), F.lit(False)) if ids else out

    return F.exists("elements", hit)


def with_quality(parsed: DataFrame, html: str = "html", min_length: int = MIN_LENGTH) -> DataFrame:
    """Quality score and its ingredients."""
    floor = max(300, int(min_length * 0.3))
    words_floor = max(80, floor // 4)
    body = F.col(html)
    words = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))
    one = F.lit(1.0)
    basic = sum((H.has(t).cast("int") for t in ("html", "head", "body", "title")), F.lit(0)) / 4.0
    semantic = F.least(one, sum((H.has(t).cast("int") for t in SEMANTIC_TAGS), F.lit(0)) / 3.0)
    content = F.least(one, H.count(*CONTENT_TAGS) / 10.0)
    tags = F.transform("elements", lambda e: e["tag"])
    p = parsed.withColumns(
        {
            "content_length": F.length(body),
            "html_words": words,
            "text_length": F.length(H.page_text()),
            "element_count": F.size("elements"),
            "structure": basic * 0.3 + semantic * 0.4 + content * 0.3,
            "diversity": F.size(F.array_distinct(tags)) / F.greatest(F.size(tags), F.lit(1)),
            "has_navigation": H.has("nav", "header", "menu") | _class_or_id("nav|menu|header", False),
            "has_main": H.has("main", "article", "section") | _class_or_id("main|content|article", True),
            "error_words": count_hits(F.lower(body), ERROR_PHRASES),
        }
    )
    score = (
        F.least(one, F.col("content_length") / float(floor)) * 0.25
        + F.least(one, F.col("html_words") / float(words_floor)) * 0.20
        + F.col("structure") * 0.25
        + F.least(one, ratio(F.col("text_length"), F.col("content_length")) * 2) * 0.15
        + F.least(one, F.col("diversity") * 2) * 0.10
        + F.when(F.col("has_navigation"), 0.025).otherwise(0.0)
        + F.when(F.col("has_main"), 0.025).otherwise(0.0)
        - F.least(F.lit(0.2), F.col("error_words") * 0.05)
    )
    density = F.least(one, ratio(F.col("text_length"), F.col("content_length")) * 1.5)
    content_score = (
        F.least(one, F.col("content_length") / float(floor)) * 0.3
        + F.least(one, F.col("text_words") / float(words_floor)) * 0.2
        + F.col("structure") * 0.3
        + density * 0.2
    )
    return p.withColumns(
        {
            "quality_score": F.round(F.least(one, F.greatest(F.lit(0.0), score)), 9),
            "content_score": F.round(content_score, 9),
        }
    )


def first_counts(quality: DataFrame, domain: str, order: str) -> DataFrame:
    """Element count of the first page of each domain, which later pages are held against."""
    first = F.min_by(F.struct("element_count", F.col(order).alias("at")), F.col(order))
    return quality.groupBy(domain).agg(first.alias("_f")).select(domain, F.col("_f.element_count").alias("base_count"), F.col("_f.at").alias("base_at"))


def recent_counts(quality: DataFrame, domain: str, us: str, order: str, pages: int = 10, width: float = DAY) -> DataFrame:
    """Mean element count over the previous ten pages of the domain, at each page."""
    return trailing_rows(quality, domain, us, order, pages, {"recent_count": F.avg("element_count")}, before=True, width=width)


def with_silent_block(quality: DataFrame, domain: str, order: str, html: str = "html", min_length: int = MIN_LENGTH) -> DataFrame:
    """Silent block: no body, an error page by its headings, or two of the weaker signals."""
    j = quality.join(first_counts(quality, domain, order), domain, "left")
    limit = max(200, int(min_length * MIN_RATIO))
    short = F.length(H.trimmed(F.col(html))) < limit
    later = F.col(order) != F.col("base_at")
    thin = later & (F.col("element_count") < F.col("base_count") * MIN_RATIO)
    few = F.col("text_words") < 20
    dull = ratio(F.col("top_word"), F.col("text_words")) > 0.35
    lean = F.col("text_words") / F.greatest(F.col("html_words"), F.lit(1)) < 0.2
    holder = H.page_text().rlike("(?i)" + PLACEHOLDER_PATTERN)
    signals = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (short, thin, few, dull, lean, holder)), F.lit(0))
    box = F.exists("elements", lambda e: (e["tag"] == "div") & H.class_text(e).rlike("error|404|not.?found"))
    heads = F.exists("elements", lambda e: e["tag"].isin("h1", "title") & H.raw_text(e).rlike(BLOCK_PAGE_PATTERN))
    return j.withColumns({"silent_signals": signals, "silent_block": ~H.has("body") | box | heads | (signals >= 2)})


def verdicts(pages: DataFrame, domain: str, order: str, *keep: str, html: str = "html") -> DataFrame:
    """Validity, block type, confidence, quality and warning codes per page."""
    p = with_silent_block(with_quality(pages, html), domain, order, html)
    p = p.withColumns(block_verdict(F.col(html)))
    empty = F.length(H.trimmed(F.col(html))) < 10
    captcha = is_captcha_page(F.col(html))
    missing = F.array_compact(F.array(*[F.when(~H.has(t), F.lit(t)) for t in REQUIRED_TAGS]))
    p = p.withColumns({"_captcha": captcha, "_missing": missing})
    quality = F.round(F.when(F.size("_missing") > 0, F.col("quality_score") * 0.8).otherwise(F.col("quality_score")), 9)
    hit = F.col("blocked") | F.col("_captcha") | F.col("silent_block")
    kind = F.when(F.col("silent_block"), "silent_block").when(F.col("_captcha"), "captcha").when(F.col("blocked"), F.col("block_type"))
    sure = (
        F.when(F.col("silent_block"), 0.7)
        .when(F.col("_captcha"), 0.9)
        .when(F.col("blocked"), F.col("block_confidence"))
        .when(quality < QUALITY_LIMIT, quality)
        .otherwise(1.0)
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_captcha"), "captcha"),
            F.when(F.col("quality_score") < QUALITY_LIMIT, "low_quality"),
            F.when(F.size("_missing") > 0, "missing_elements"),
            F.when(F.col("silent_block"), "silent_block"),
        )
    )
    advice = F.array_compact(
        F.array(
            F.when(hit, F.when(kind == "captcha", "change_proxy").when(kind == "rate_limit", "slow_down").when(kind == "bot_detection", "change_agent").when(kind == "silent_block", "check_proxy")),
            F.when(quality < QUALITY_LIMIT, "check_page"),
            F.when(F.size("_missing") > 0, "wait_for_elements"),
            F.when(F.col("content_length") < MIN_LENGTH, "too_short"),
        )
    )
    zero = F.lit(0.0)
    return p.select(
        *keep,
        (~empty & ~hit & (quality >= HARD_LIMIT)).alias("is_valid"),
        F.when(~empty, kind).alias("block_type"),
        F.when(empty, zero).otherwise(sure).cast("double").alias("confidence"),
        F.when(empty, zero).otherwise(quality).alias("quality_score"),
        F.when(empty, F.array(F.lit("empty"))).otherwise(warnings).alias("warnings"),
        F.when(~empty, advice).alias("advice"),
    )


def error_messages(parsed: DataFrame, *keep: str) -> DataFrame:
    """Distinct error texts in title, headings, error boxes and meta descriptions, one row each."""
    pattern = "(?iu)" + "|".join(ERROR_PATTERNS)

    def texts(items: Column, label: str, text) -> Column:
        found = F.filter(F.transform(items, text), lambda t: t.rlike(pattern))
        return F.transform(found, lambda t: F.concat(F.lit(label), t))

    plain = lambda e: H.trimmed(H.raw_text(e))
    boxes = F.filter(
        "elements", lambda e: e["tag"].isin("div", "p", "span") & H.class_text(e).rlike("(?i)error|warning|alert|block")
    )
    sized = F.filter(F.transform(boxes, plain), lambda t: (F.length(t) > 10) & (F.length(t) < 200))
    metas = F.filter("elements", lambda e: (e["tag"] == "meta") & F.coalesce(H.attr(e, "name").isin("description", "keywords"), F.lit(False)))
    every = F.concat(
        texts(F.slice(H.every("title"), 1, 1), "Title: ", plain),
        texts(H.every("h1", "h2", "h3"), "Heading: ", plain),
        texts(sized, "Container: ", lambda t: t),
        texts(metas, "Meta: ", lambda e: F.coalesce(H.attr(e, "content"), F.lit(""))),
    )
    return parsed.select(*keep, F.explode(F.array_distinct(every)).alias("message"))


# --- duplicates ------------------------------------------------------------------------------------------


def fingerprint(text: Column) -> Column:
    """MD5 of the first 500 characters of the page text."""
    return F.md5(F.substring(text, 1, 500))


def duplicate_groups(rows: DataFrame, key: str, mark: Column) -> DataFrame:
    """Groups of rows with the same content mark: size and first member; members are never gathered."""
    g = rows.groupBy(mark.alias("mark")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"))
    return g.where(F.col("n") > 1)


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct hashes of runs of ``size`` words (the whole text when it has fewer)."""

    def runs(words: Column) -> Column:
        last = F.greatest(F.size(words) - size + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))

    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    # the one-element array binds the word list once instead of once per run
    return F.array_distinct(F.element_at(F.transform(F.array(words), runs), 1))


def version_similarity(old: DataFrame, new: DataFrame, key: str, text: str, limit: float = 0.95) -> DataFrame:
    """Jaccard similarity of word runs between two versions of the same page; equi-join on the page."""
    a = old.select(key, shingles(F.col(text)).alias("_a"))
    b = new.select(key, shingles(F.col(text)).alias("_b"))
    j = a.join(b, key)
    inter = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - inter
    sim = F.when(union == 0, 1.0).otherwise(inter / union)
    return j.select(key, F.round(sim, 9).alias("similarity"), (sim > limit).alias("unchanged"))


# --- classes and ids ---------------------------------------------------------------------------------------


def frequent_classes(parsed: DataFrame, *by: str, n: int = 10) -> DataFrame:
    """Most frequent CSS classes (seen more than once), per group when asked."""
    from pyspark.sql import Window

    lists = F.flatten(F.transform("elements", lambda e: F.filter(F.split(H.class_text(e), r"\s+"), lambda c: c != "")))
    counts = parsed.select(*by, F.explode(lists).alias("class")).groupBy(*by, "class").agg(F.count("*").alias("n")).where("n > 1")
    if not by:
        return counts.orderBy(F.desc("n"), "class").limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "class")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def page_ids(parsed: DataFrame, *keep: str) -> DataFrame:
    """Distinct element ids per page."""
    ids = F.array_distinct(F.array_compact(F.transform("elements", lambda e: F.nullif(H.attr(e, "id"), F.lit("")))))
    return parsed.select(*keep, F.explode(ids).alias("id"))
