"""Page-corpus queries. Marks that the given pages lack are added to every n-th page on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogwatch.functions import urls as U
from catalogwatch.functions.text import normalised_entropy, sanitise
from catalogwatch.operators import cms as C
from catalogwatch.operators import html_table as H
from catalogwatch.operators import pages as P
from catalogwatch.plans.registry import query, table
from catalogwatch.session import spread

DECODE = "replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"
NO_SCRIPT = "regexp_replace(html, '<!DOCTYPE[^>]*>|<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs')"
# Text pieces between tags, stripped and joined.
PIECES = f"list_transform(string_split_regex({NO_SCRIPT}, '<[^>]*>'), lambda x: trim({DECODE.format('x')}, ' \t\n\r'))"
TEXT = f"array_to_string({PIECES}, '')"
NETLOC = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
COUNT = "len(regexp_extract_all(html, '<{}[ >/]'))"

# Every n-th page gets the marks of a kind of page that the corpus does not hold.
EXTRA = (
    (11, "<div class=\"g-recaptcha\" data-sitekey=\"KEY1\"></div>"),
    (13, "<p>Too many requests, slow down</p>"),
    (17, "<p>Error 403: bot detected</p>"),
    (19, "<meta name=\"robots\" content=\"noindex\"><link rel=\"canonical\" href=\"/c\"><img src=\"a.png\" alt=\" A \">"),
    (23, "<link href=\"/wp-content/plugins/shop-x/a.css\"><i class=\"wp-a\">wordpress 6.1</i>"),
    (29, "<script src=\"//cdn.shopify.com/s\">Shopify.shop</script>"),
    (31, "<span itemprop=\"price\">10</span>"),
)
# Further shop systems, for what is read per system.
SYSTEMS = (
    (37, "<meta name=\"generator\" content=\"Joomla! 3.9\"><div class=\"mod-x\"><img src=\"/components/com_cart/a.png\"></div>"),
    (41, "<script src=\"/bitrix/modules/sale/a.js\">BX.message({})</script><p>bitrix 20.5</p>"),
    (43, "<a href=\"index.php?route=product/p\">OpenCart</a><i>opencart 3.0</i><img src=\"/vqmod/vqcache/mod1/x.png\">"),
)


def marked_sql(extra):
    return "marked AS (SELECT page_id, url, html" + "".join(
        f" || CASE WHEN page_id % {n} = 0 THEN '{t}' ELSE '' END" for n, t in extra
    ) + " AS html FROM pages)"


MARKED = marked_sql(EXTRA)


def marked(spark, d, extra=EXTRA):
    html = F.col("html")
    for n, t in extra:
        html = F.concat(html, F.when(F.col("page_id") % n == 0, F.lit(t)).otherwise(F.lit("")))
    return spread(table(spark, d, "pages")).select("page_id", "url", html.alias("html"))


@query(
    "seo_fields",
    f"""WITH {MARKED} SELECT page_id, nullif(trim({DECODE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}), '') AS title,
      nullif(trim({DECODE.format("regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}), '') AS h1,
      CASE WHEN page_id % 19 = 0 THEN '/c' END AS canonical, CASE WHEN page_id % 19 = 0 THEN 'noindex' END AS robots,
      CASE WHEN page_id % 19 = 0 THEN 'A' END AS images_alt_joined FROM marked""",
)
def seo_fields(spark, d):
    """SEO fields of every page."""
    return P.seo_fields(H.parse_pages(marked(spark, d)), "page_id").select(
        "page_id", "title", "h1", "canonical", "robots", "images_alt_joined"
    )


# Things that look like links and the other way round, in every fifth page.
LINKED = """<a data-href="/no">x</a><!-- <a href="/comment">c</a> --><script>var s = '<a href="/script">s</a>';</script><A class=b HREF=/bare>b</A><a title="> x" href='/q?a=1&amp;b=2#f'>q</a><a href="#top">t</a>"""


@query(
    "page_links",
    f"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    t AS (SELECT page_id, root || {DECODE.format('href')} AS target FROM l
      UNION ALL SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || unnest(['/bare', '/q?a=1&b=2']) FROM pages WHERE page_id % 5 = 0)
    SELECT page_id, target, count(*) AS n FROM t GROUP BY ALL""",
)
def page_links(spark, d):
    """Absolute link targets of every page."""
    extra = F.when(F.col("page_id") % 5 == 0, F.lit(LINKED)).otherwise(F.lit(""))
    pages = table(spark, d, "pages").select("page_id", "url", F.concat("html", extra).alias("html"))
    out = P.page_links(pages, "url", "html", "page_id")
    return out.groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(
    "page_structure",
    f"""WITH s AS (SELECT page_id, html, length({TEXT}) AS text_length, len(regexp_extract_all({NO_SCRIPT}, '<[a-zA-Z]')) + 2 AS element_count FROM pages)
    SELECT page_id, TRUE AS has_html, TRUE AS has_head, TRUE AS has_body, contains(html, '<title>') AS has_title, CAST(text_length AS INTEGER) AS text_length,
      CAST(element_count AS INTEGER) AS element_count, CAST({COUNT.format('a')} AS INTEGER) AS link_count, CAST(0 AS INTEGER) AS image_count,
      CAST(1 AS INTEGER) AS script_count, text_length / length(html) AS text_ratio, CAST(100 AS INTEGER) AS structure_score, TRUE AS valid FROM s""",
)
def page_structure(spark, d):
    """Skeleton, counts and structure score."""
    return P.page_structure(H.parse_pages(table(spark, d, "pages")), "page_id")


def _sql_any(c, phrases):
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


def _sql_rx(c, patterns):
    return "regexp_matches({}, '{}', 'i')".format(c, "|".join(p.replace("'", "''") for p in patterns))


BLOCK_SQL = f"""low AS (SELECT *, lower(html) AS t FROM marked),
blk AS (SELECT *, {' + '.join(f"contains(t, '{p}')::INT" for p in P.BLOCK_PHRASES)} AS phrases, {_sql_rx('t', P.CAPTCHA_PATTERNS)} AS cap, {_sql_rx('t', P.RATE_PATTERNS)} AS rate,
  {_sql_rx('t', P.BOT_PATTERNS)} AS bot, {_sql_any('t', P.STATUS_PHRASES)} AS status FROM low),
verdict AS (SELECT *, phrases > 0 OR cap OR rate OR bot OR status AS blocked,
  CASE WHEN status THEN 'http_error' WHEN bot THEN 'bot_detection' WHEN rate THEN 'rate_limit' WHEN cap THEN 'captcha' END AS block_type,
  CASE WHEN cap THEN 0.95 WHEN rate THEN 0.9 WHEN bot THEN 0.85 WHEN status THEN 0.8 ELSE least(0.8, phrases * 0.2) END::DOUBLE AS block_confidence,
  cap OR {_sql_any('t', P.CAPTCHA_SERVICES)} AS captcha_page FROM blk)"""


@query("block_verdicts", f"WITH {MARKED}, {BLOCK_SQL} SELECT page_id, blocked, block_type, block_confidence, phrases AS block_phrases FROM verdict")
def block_verdicts(spark, d):
    """Blocked pages with type and confidence."""
    m = marked(spark, d)
    return m.select("page_id", *[c.alias(n) for n, c in P.block_verdict(F.col("html")).items()])


@query(
    "page_guards",
    f"""WITH {MARKED}, {BLOCK_SQL} SELECT page_id, {_sql_any('t', P.GUARD_PHRASES)} AS guard, captcha_page, {_sql_any('t', P.RATE_PHRASES)} OR page_id % 7 = 0 AS rate_limited,
      {' + '.join(f"contains(t, '{p}')::INT" for p in P.SCRIPT_SIGNS)} > 3 OR len(string_split(t, '<script')) - 1 > 5 AS script_heavy,
      concat_ws(',', {', '.join(f"CASE WHEN {_sql_any('t', w)} THEN '{n}' END" for n, w in sorted(P.CHALLENGES))}) AS challenges FROM verdict""",
)
def page_guards(spark, d):
    """Guard, captcha, rate-limit and script-heavy predicates with challenge marks."""
    h = F.col("html")
    headers = F.create_map(F.when(F.col("page_id") % 7 == 0, "Retry-After").otherwise("Server"), F.lit("1"))
    return marked(spark, d).select(
        "page_id",
        P.is_guard_page(h).alias("guard"),
        P.is_captcha_page(h).alias("captcha_page"),
        P.is_rate_limited(h, headers).alias("rate_limited"),
        P.is_script_heavy(h).alias("script_heavy"),
        F.array_join(P.challenges(h), ",").alias("challenges"),
    )


QUALITY_SQL = f"""q0 AS (SELECT page_id, url, html, {NETLOC} AS domain, length(html) AS content_length,
    len(list_filter(string_split_regex(html, '\\s+'), lambda w: w <> '')) AS html_words, {TEXT} AS txt,
    regexp_extract_all({NO_SCRIPT}, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS tags FROM marked),
q1 AS (SELECT *, length(txt) AS text_length, list_concat(tags, ['style', 'script'], CASE WHEN page_id % 29 = 0 THEN ['script'] ELSE [] END) AS every_tag,
    list_filter(string_split_regex(lower(txt), '\\s+'), lambda w: w <> '') AS words,
    {' + '.join(f"contains(lower(html), '{p}')::INT" for p in P.ERROR_PHRASES)} AS error_words FROM q0),
q2 AS (SELECT *, len(every_tag) AS element_count, len(list_distinct(every_tag)) / len(every_tag) AS diversity, len(words) AS text_words,
    list_max(map_values(list_histogram(words))) AS top_word,
    (1.0 * 0.3 + least(1.0, 3 / 3.0) * 0.4 + least(1.0, len(list_filter(tags, lambda x: list_contains(['h1','h2','h3','p','div','span'], x))) / 10.0::DOUBLE) * 0.3)::DOUBLE AS structure FROM q1),
quality AS (SELECT *, round(least(1.0, greatest(0.0, least(1.0, content_length / 300.0::DOUBLE) * 0.25 + least(1.0, html_words / 80.0::DOUBLE) * 0.2 + structure * 0.25
    + least(1.0, text_length / content_length * 2) * 0.15 + least(1.0, diversity * 2) * 0.1 + 0.025 + 0.025 - least(0.2, error_words * 0.05))), 9)::DOUBLE AS quality_score,
    round(least(1.0, content_length / 300.0::DOUBLE) * 0.3 + least(1.0, text_words / 80.0::DOUBLE) * 0.2 + structure * 0.3 + least(1.0, text_length / content_length * 1.5) * 0.2, 9)::DOUBLE AS content_score
  FROM q2)"""


def quality_table(spark, d):
    m = marked(spark, d).withColumn("domain", U.netloc_of(F.col("url")))
    return P.with_quality(H.parse_pages(m))


@query(
    "page_quality",
    f"""WITH {MARKED}, {QUALITY_SQL} SELECT page_id, CAST(content_length AS INTEGER) AS content_length, CAST(html_words AS INTEGER) AS html_words,
      CAST(text_words AS INTEGER) AS text_words, CAST(element_count AS INTEGER) AS element_count, quality_score, content_score FROM quality""",
)
def page_quality(spark, d):
    """Quality scores and their ingredients."""
    return quality_table(spark, d).select(
        "page_id", "content_length", "html_words", "text_words", "element_count", "quality_score", "content_score"
    )


SILENT_SQL = f"""{QUALITY_SQL}, base AS (SELECT domain, arg_min(element_count, page_id) AS base_count, min(page_id) AS base_at FROM quality GROUP BY domain),
silent AS (SELECT q.*, (length(trim(html, ' \t\n\r')) < 300)::INT + (page_id <> base_at AND element_count < base_count * 0.3)::INT + (text_words < 20)::INT
    + (top_word / text_words > 0.35)::INT + (text_words / greatest(html_words, 1) < 0.2)::INT + regexp_matches(txt, '{P.PLACEHOLDER_PATTERN}', 'i')::INT AS signals,
    regexp_matches(regexp_extract(html, '<title>(.*?)</title>', 1) || ' ' || regexp_extract(html, '<h1>(.*?)</h1>', 1), 'error|404|not found|blocked', 'i') AS bad_head
  FROM quality q JOIN base USING (domain))"""


@query("silent_blocks", f"WITH {MARKED}, {SILENT_SQL} SELECT page_id, signals AS silent_signals, bad_head OR signals >= 2 AS silent_block FROM silent")
def silent_blocks(spark, d):
    """Silent-block signals per page."""
    return P.with_silent_block(quality_table(spark, d), "domain", "page_id").select("page_id", "silent_signals", "silent_block")


@query(
    "page_verdicts",
    f"""WITH {MARKED}, {BLOCK_SQL}, {SILENT_SQL}, j AS (SELECT s.page_id, s.quality_score AS q, v.blocked, v.block_type AS bt, v.block_confidence AS bc, v.captcha_page AS cp,
      bad_head OR signals >= 2 AS sb FROM silent s JOIN verdict v USING (page_id))
    SELECT page_id, NOT (blocked OR cp OR sb) AND q >= 0.5 AS is_valid, CASE WHEN sb THEN 'silent_block' WHEN cp THEN 'captcha' WHEN blocked THEN bt END AS block_type,
      CASE WHEN sb THEN 0.7 WHEN cp THEN 0.9 WHEN blocked THEN bc WHEN q < 0.7 THEN q ELSE 1.0 END::DOUBLE AS confidence, q AS quality_score,
      concat_ws(',', CASE WHEN cp THEN 'captcha' END, CASE WHEN q < 0.7 THEN 'low_quality' END, CASE WHEN sb THEN 'silent_block' END) AS warnings FROM j""",
)
def page_verdicts(spark, d):
    """Validity verdict per page."""
    m = marked(spark, d).withColumn("domain", U.netloc_of(F.col("url")))
    out = P.verdicts(H.parse_pages(m), "domain", "page_id", "page_id")
    return out.select("page_id", "is_valid", "block_type", "confidence", "quality_score", F.array_join("warnings", ",").alias("warnings"))


@query(
    "recent_element_counts",
    f"""WITH {MARKED}, {QUALITY_SQL} SELECT page_id, domain, round(avg(element_count) OVER (PARTITION BY domain ORDER BY page_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS recent_count
    FROM quality""",
)
def recent_element_counts(spark, d):
    """Mean element count of the previous ten pages of the domain."""
    q = quality_table(spark, d).select("page_id", "domain", "element_count")
    out = P.recent_counts(q, "domain", "page_id", "page_id", width=0.001)
    return out.select("page_id", "domain", F.round("recent_count", 6).alias("recent_count"))


@query(
    "error_messages",
    f"""WITH t AS (SELECT page_id, trim({DECODE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS a,
      trim({DECODE.format("regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}) AS b FROM pages)
    SELECT page_id, 'Title: Access denied ' || a AS message FROM t WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, 'Heading: Access denied ' || b FROM t WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, 'Container: request blocked here' FROM t WHERE page_id % 5 = 0""",
)
def error_messages(spark, d):
    """Error texts in titles, headings and boxes."""
    h = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<(title|h1)>", "<$1>Access denied ")).otherwise(F.col("html"))
    box = F.when(F.col("page_id") % 5 == 0, F.lit('<div class="Alert-box"> request blocked here </div>')).otherwise(F.lit(""))
    p = table(spark, d, "pages").select("page_id", F.concat(h, box).alias("html"))
    return P.error_messages(H.parse_pages(p), "page_id")


@query(
    "captcha_census",
    f"""WITH {MARKED} SELECT CASE WHEN page_id % 11 = 0 THEN 'recaptcha_v2' END AS captcha_type, count(*) AS n, count(*) FILTER (WHERE page_id % 11 = 0) AS with_key
    FROM marked WHERE NOT regexp_matches(html, 'verification.*image|security.*code', 'i') OR page_id % 11 = 0 GROUP BY 1""",
)
def captcha_census(spark, d):
    """Captcha kinds over the corpus, and how many show a site key."""
    m = marked(spark, d).withColumns(P.captcha_type(F.col("html")))
    return m.groupBy("captcha_type").agg(F.count("*").alias("n"), F.count_if("has_site_key").alias("with_key"))


@query("product_pages", "SELECT page_id FROM pages WHERE page_id % 31 = 0")
def product_pages(spark, d):
    """Pages that look like product pages."""
    return H.parse_pages(marked(spark, d)).where(P.is_product_page()).select("page_id")


def _cms_place(place, col):
    groups = C._by_system(C.default_marks(), place)
    arms = []
    for s, ps in groups.items():
        esc = [p.replace("'", "''") for p in ps]
        score = "1.0" if place == "js" else "(" + " + ".join(f"regexp_matches({col}, '{p}', 'i')::INT" for p in esc) + f") / {float(len(ps))}::DOUBLE"
        arms.append(f"WHEN regexp_matches({col}, '{'|'.join(f'(?:{p})' for p in esc)}', 'i') THEN {{'s': '{s}', 'v': ({score})::DOUBLE}}")
    return "CASE " + " ".join(arms) + " END"


CMS_SQL = f"""{MARKED}, places AS (SELECT page_id, [{_cms_place('meta', 'html')}, {_cms_place('html', 'html')}, {_cms_place('url', 'url')}, {_cms_place('js', 'html')}] AS l FROM marked),
flat AS (SELECT page_id, unnest(l) AS x, unnest(range(1, 5)) AS i FROM places),
sums AS (SELECT page_id, x.s AS s, round(sum(x.v), 9) AS v, min(i) AS i FROM flat WHERE x IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY v DESC, i) = 1),
cms AS (SELECT m.page_id, m.html, m.url, CASE WHEN v IS NULL THEN 0.0 ELSE least(v, 1.0) END::DOUBLE AS confidence, CASE WHEN least(v, 1.0) >= 0.3 THEN s END AS cms FROM marked m LEFT JOIN best USING (page_id))"""


@query("cms_detection", f"WITH {CMS_SQL} SELECT page_id, cms, confidence FROM cms")
def cms_detection(spark, d):
    """Shop system and confidence per page."""
    return C.detect(marked(spark, d)).select("page_id", "cms", "confidence")


@query("cms_census", f"WITH {CMS_SQL} SELECT coalesce(cms, 'unknown') AS cms, count(*) AS pages, round(sum(confidence), 9) / count(confidence) AS avg_confidence FROM cms GROUP BY 1")
def cms_census(spark, d):
    """Shop systems over the corpus."""
    return C.census(C.detect(marked(spark, d)))


@query(
    "cms_details",
    """SELECT page_id, 'wordpress' AS cms, TRUE AS confirmed, '6.1' AS version, 'shop-x' AS plugins FROM pages WHERE page_id % 23 = 0""",
)
def cms_details(spark, d):
    """Confirmation, version and plug-ins of the pages that are found to be of one system."""
    found = _details(C.detect(marked(spark, d)))
    # The test sits in a generator: a filter would be pushed down and the detection's columns be put into each other.
    return found.select(F.inline(F.filter(F.array(F.struct("*")), lambda x: x["cms"] == "wordpress")))


def _details(detected):
    h, s = F.col("html"), F.col("cms")
    return detected.select(
        "page_id", "cms", C.is_confirmed(s, F.col("url"), h).alias("confirmed"), C.version_of(s, h).alias("version"),
        F.array_join(C.plugins_of(s, h), ",").alias("plugins"),
    )


def _details_sql():
    """Columns of :func:`_details` over the table ``cms``."""
    groups = {p: C._by_system(C.default_marks(), p) for p in ("meta", "html", "url", "version", "plugin")}
    sql = lambda p: "'" + p.replace("'", "''") + "'"
    confirmed = ["WHEN 'sixwool' THEN contains(url, '6wool.ru') OR contains(lower(html), '6wool')"]
    for name in dict.fromkeys(m.system for m in C.default_marks()):
        known = [(p, groups[p][name]) for p in ("meta", "html", "url") if name in groups[p]]
        hits = [f"regexp_matches({'url' if p == 'url' else 'html'}, {sql('|'.join(f'(?:{x})' for x in ps))}, 'i')::INT" for p, ps in known]
        confirmed.append(f"WHEN '{name}' THEN {' + '.join(hits)} >= {min(2, len(known))}")
    first = lambda p: f"nullif(regexp_extract(html, {sql(p)}, 1, 'i'), '')"
    every = lambda p: f"regexp_extract_all(html, {sql(p)}, 1, 'i')"
    version = [f"WHEN '{n}' THEN coalesce({', '.join(map(first, ps))})" for n, ps in groups["version"].items()]
    plugins = [
        f"WHEN '{n}' THEN array_to_string(list_sort(list_distinct(flatten([{', '.join(map(every, ps))}]))), ',')" for n, ps in groups["plugin"].items()
    ]
    return f"""page_id, cms, CASE cms {' '.join(confirmed)} ELSE FALSE END AS confirmed, CASE cms {' '.join(version)} END AS version,
      CASE cms {' '.join(plugins)} ELSE '' END AS plugins"""


@query("cms_page_details", f"WITH {CMS_SQL.replace(MARKED, marked_sql(EXTRA + SYSTEMS))} SELECT {_details_sql()} FROM cms")
def cms_page_details(spark, d):
    """Shop system, confirmation, version and plug-ins of every page."""
    return _details(C.detect(marked(spark, d, EXTRA + SYSTEMS)))


@query(
    "duplicate_documents",
    "SELECT sha256(text) AS mark, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_documents(spark, d):
    """Groups of documents with the same content hash."""
    return P.duplicate_groups(table(spark, d, "documents"), "doc_id", F.sha2("text", 256))


@query(
    "duplicate_fingerprints",
    "SELECT md5(substring(text, 1, 500)) AS mark, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_fingerprints(spark, d):
    """Groups of documents with the same opening fingerprint."""
    return P.duplicate_groups(table(spark, d, "documents"), "doc_id", P.fingerprint(F.col("text")))


def _runs(c):
    words = f"list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: w <> '')"
    return f"(SELECT list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) FROM (SELECT {words} AS w))"


@query(
    "version_similarity",
    f"""WITH s AS (SELECT doc_id, {_runs("regexp_replace(text, '[0-9]+', '', 'g')")} AS a, {_runs('text')} AS b FROM documents),
    n AS (SELECT doc_id, len(list_intersect(a, b)) AS i, len(a) AS x, len(b) AS y FROM s)
    SELECT doc_id, round(i / (x + y - i), 9) AS similarity, i / (x + y - i) > 0.95 AS unchanged FROM n""",
)
def version_similarity(spark, d):
    """Similarity of each document to a version of itself that lost its digits."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    older = docs.withColumn("text", F.regexp_replace("text", r"[0-9]+", ""))
    return P.version_similarity(older, docs, "doc_id", "text")


@query(
    "frequent_classes",
    f"""WITH {MARKED} SELECT class, count(*) AS n FROM (SELECT unnest(string_split(trim(c), ' ')) AS class
      FROM (SELECT unnest(regexp_extract_all(html, '<[a-z][^>]*class="([^"]*)"', 1)) AS c FROM marked))
    GROUP BY class HAVING count(*) > 1 ORDER BY n DESC, class LIMIT 10""",
)
def frequent_classes(spark, d):
    """Ten most frequent CSS classes."""
    return P.frequent_classes(H.parse_pages(marked(spark, d)))


@query(
    "page_ids",
    """SELECT page_id, unnest(list_distinct(['box', 'k' || (page_id % 5), 'box' || CASE WHEN page_id % 2 = 0 THEN '' ELSE '2' END])) AS id FROM pages""",
)
def page_ids(spark, d):
    """Distinct element ids of every page."""
    n = F.col("page_id")
    extra = F.concat(
        F.lit("<p id=box>a</p><p id='k"), (n % 5).cast("string"), F.lit("'><i id=\"\"></i><b ID=\"box"), F.when(n % 2 == 0, "").otherwise("2"), F.lit("\">b</b>")
    )
    pages = table(spark, d, "pages").select("page_id", F.concat("html", extra).alias("html"))
    return P.page_ids(H.parse_pages(pages), "page_id")


@query(
    "clean_documents",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f\\x{80}-\\x{9f}]', '', 'g'), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS clean FROM documents",
)
def clean_documents(spark, d):
    """Documents without control characters and runs of white space."""
    return table(spark, d, "documents").select("doc_id", sanitise(F.col("text")).alias("clean"))


@query(
    "text_entropy",
    """WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS x FROM documents),
    c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(x, '')) AS ch FROM t WHERE length(x) >= 10) GROUP BY ALL),
    s AS (SELECT doc_id, sum(n) AS total, count(*) AS kinds FROM c GROUP BY doc_id)
    SELECT t.doc_id, round(coalesce((SELECT -sum(n / total * log2(n / total)) / nullif(log2(least(256, any_value(kinds))), 0) FROM c JOIN s USING (doc_id) WHERE c.doc_id = t.doc_id), 0), 6) AS entropy FROM t""",
)
def text_entropy(spark, d):
    """Normalised character entropy per document."""
    return table(spark, d, "documents").select("doc_id", F.round(normalised_entropy(F.col("text")), 6).alias("entropy"))
