"""Shop-system census over a page corpus."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogwatch.functions import urls as U
from catalogwatch.functions.values import any_of, steady_mean
from catalogwatch.operators.pages import is_guard_page

# Marks of shop systems, one per line as "system place pattern"; the order of the
# systems decides which one a place reports. Places: meta and html are looked up in the page,
# url in its address, js in its scripts; version and plugin patterns carry the value in group 1.
MARKS_TEXT = r"""
wordpress meta wordpress
wordpress meta wp-
wordpress meta woocommerce
wordpress html wp-content
wordpress html wp-includes
wordpress html class=["']wp-
wordpress html id=["']wp-
wordpress url /wp-admin/
wordpress url /wp-content/
wordpress url /wp-includes/
wordpress url /wp-json/
wordpress js typeof\s+wp\s*!==?\s*["']undefined["']
wordpress js wp\.
wordpress version wordpress\s*([\d.]+)
wordpress version version:\s*([\d.]+)
wordpress plugin wp-content/plugins/([^/]+)
wordpress plugin (woocommerce)
wordpress plugin (contact-form-7)
wordpress plugin (yootheme)
joomla meta joomla
joomla meta com_virtuemart
joomla meta virtuemart
joomla meta jdoc
joomla html joomla
joomla html com_content
joomla html class=["']mod-
joomla html id=["']mod-
joomla url /administrator/
joomla url /components/
joomla url /modules/
joomla url /index\.php\?option=
joomla js typeof\s+Joomla\s*!==?\s*["']undefined["']
joomla js Joomla\.
joomla version joomla[\s!]*([\d.]+)
joomla version version[\s:]*([\d.]+)
joomla plugin com_([^/]+)
joomla plugin mod_([^/]+)
joomla plugin (virtuemart)
magento meta magento
magento meta mage
magento html magento
magento html var\s+formkey
magento html class=["']product-
magento html data-mage
magento url /media/
magento url /skin/
magento url /js/
magento url /index\.php/
magento js typeof\s+Mage\s*!==?\s*["']undefined["']
magento js Mage\.
magento version magento\s*([\d.]+)
magento version version[\s:]*([\d.]+)
magento plugin community/([^/]+)
magento plugin local/([^/]+)
shopify meta shopify
shopify meta myshopify
shopify html shopify
shopify html cdn\.shopify\.com
shopify html class=["']shopify-
shopify html data-shopify
shopify url myshopify\.com
shopify url /collections/
shopify url /products/
shopify url /cart
shopify js typeof\s+Shopify\s*!==?\s*["']undefined["']
shopify js Shopify\.
shopify version shopify\s*theme\s*([\d.]+)
bitrix meta bitrix
bitrix meta b24
bitrix meta bx:component
bitrix html bitrix
bitrix html bx-
bitrix html /bitrix/
bitrix html JCCatalogElement
bitrix html data-bx-id
bitrix url /bitrix/
bitrix url /upload/
bitrix url iblock
bitrix url /local/
bitrix url /ajax/
bitrix js typeof\s+BX\s*!==?\s*["']undefined["']
bitrix js BX\.
bitrix js window\.JCCatalogElement
bitrix js BX\.message
bitrix version bitrix\s*([\d.]+)
bitrix plugin /bitrix/modules/([^/]+)
bitrix plugin /local/components/([^/]+)
sixwool meta 6wool
sixwool meta jawoll
sixwool meta bm_custom_theme
sixwool html 6wool
sixwool html data-sixwool
sixwool html sixwool-variation
sixwool html ddos-guard
sixwool html JCCatalogElement
sixwool url 6wool\\.ru
sixwool url /local/templates/6wool
sixwool url /ajax/variation
sixwool url /ajax/catalog
sixwool js window\.sixwool
sixwool js sixwoolOffers
sixwool js BX\.
sixwool js JCCatalogElement
sixwool version sixwool\s*([\d.]+)
insales meta insales
insales html insales
insales html data-product
insales html /collection/
insales html InSales
insales url /collection
insales url /product
insales url /products\.json
insales js Insales
cm3 meta cm3
cm3 meta cmshop
cm3 meta generator\s*[:=]\s*["']?cm3
cm3 html cm3-
cm3 html cmshop
cm3 html class=["']cm3-
cm3 html id=["']cm3-
cm3 url /cm3/
cm3 url /cmshop/
cm3 url cm3=
cm3 js CM3\.
cm3 js cmshop
cm3 version cm3\s*([\d.]+)
cm3 version cmshop\s*([\d.]+)
cscart meta cs-cart
cscart meta cscart
cscart meta tygh
cscart html ty-
cscart html cs-cart
cscart html data-ca-product-id
cscart html cm-picker
cscart url /dispatch=
cscart url index\.php\?dispatch=
cscart url /app/
cscart js Tygh
cscart js csCart
cscart version cs-cart\s*([\d.]+)
cscart version cscart\s*([\d.]+)
opencart meta opencart
opencart html opencart
opencart html route=product
opencart html index\.php\?route=
opencart url route=product
opencart url /index\.php\?route=
opencart url /catalog/
opencart version opencart\s*([\d.]+)
opencart plugin /vqmod/vqcache/([^/]+)
drupal meta drupal
drupal html drupal
drupal html node-
drupal html taxonomy
drupal url /node/
drupal url /user/
drupal url /admin/
drupal url /sites/default/
drupal js Drupal\.
drupal version drupal\s*([\d.]+)
drupal plugin /modules/([^/]+)
prestashop meta prestashop
prestashop meta presta
prestashop html prestashop
prestashop html id_product
prestashop html ps_
prestashop url /product\.php
prestashop url /category\.php
prestashop url /index\.php\?id_product=
prestashop js prestashop\.
prestashop version prestashop\s*([\d.]+)
prestashop plugin /modules/([^/]+)
squarespace meta squarespace
squarespace html squarespace
squarespace html squarespace\.com
squarespace html data-image
squarespace url squarespace\.com
squarespace js Squarespace
squarespace version squarespace\s*([\d.]+)
wix meta wix
wix html wix
wix html wix\.com
wix html data-wix
wix url wix\.com
wix js Wix
wix version wix\s*([\d.]+)
"""
# Site hints, score weights per place, decision limits.
SITE_HINTS = {
    "6wool.ru": ("sixwool", 0.3), "mpyarn.ru": ("cm3", 1.05), "initki.ru": ("cscart", 1.05),
    "triskeli.ru": ("insales", 1.05), "ili-ili.com": ("bitrix", 1.05),
}
PLACE_WEIGHTS = {"meta": 1.0, "html": 1.0, "url": 1.0, "js": 1.0}
SURE, LIKELY, HINT_SHARE, GUARD_BONUS = 0.6, 0.3, 0.6, 0.2


@dataclass(frozen=True)
class Mark:
    system: str
    place: str
    pattern: str


def default_marks() -> list[Mark]:
    return [Mark(*line.split(" ", 2)) for line in MARKS_TEXT.strip().splitlines()]


def _by_system(marks, place: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for m in marks:
        if m.place == place:
            out.setdefault(m.system, []).append(m.pattern)
    return out


def _hit(low: Column, pattern: str) -> Column:
    """Does the mark occur in lower-case text? Plain marks are substring tests."""
    literal = re.sub(r"\\([./])", r"\1", pattern)
    if not re.search(r"[\\^$*+?{}\[\]|()]", literal) and ("." not in literal or r"\." in pattern):
        return low.contains(literal.lower())
    return low.rlike("(?i)" + pattern)


def _any_hit(low: Column, patterns) -> Column:
    return any_of([_hit(low, p) for p in patterns])


def place_score(marks, place: str, c: Column, best: bool = False) -> Column:
    """``struct(system, score)`` that one place reports: the first system with a hit, or the best one.

    ``c`` is lower-case. Marks are literals of the plan: no page × pattern rows arise.
    """
    groups = _by_system(marks, place)
    if not groups:
        return F.lit(None).cast("struct<system:string,score:double>")
    spot = lambda s, v: F.struct(F.lit(s).alias("system"), v.cast("double").alias("score"))

    def share(patterns) -> Column:
        if place == "js":
            return F.lit(1.0)
        return sum((_hit(c, p).cast("int") for p in patterns), F.lit(0)) / F.lit(float(len(patterns)))

    some = {s: _any_hit(c, ps) for s, ps in groups.items()}
    if best:
        scored = F.array_compact(F.array(*[F.when(some[s], spot(s, share(ps))) for s, ps in groups.items()]))
        return F.aggregate(scored, F.lit(None).cast("struct<system:string,score:double>"),
                           lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x).otherwise(a))
    out = None
    for s, ps in groups.items():
        out = F.when(some[s], spot(s, share(ps))) if out is None else out.when(some[s], spot(s, share(ps)))
    return out


def detect(pages: DataFrame, url: str = "url", html: str = "html", marks=None, extra=(), hints=None, weights=None,
           best: bool = False) -> DataFrame:
    """System and confidence per page. ``extra`` adds marks of own systems after the known ones."""
    marks = [*(marks or default_marks()), *extra]
    weights = weights or PLACE_WEIGHTS
    hints = SITE_HINTS if hints is None else hints
    u, h = F.col(url), F.col(html)
    site = F.regexp_replace(F.lower(U.netloc_of(u)), r"^www\.", "")
    kind = "struct<system:string,score:double>"
    hint = None
    for domain, (system, score) in hints.items():
        value = F.struct(F.lit(system).alias("system"), F.lit(float(score)).alias("score"))
        hint = F.when(site == domain, value) if hint is None else hint.when(site == domain, value)
    hint = F.lit(None).cast(kind) if hint is None else hint
    out = pages.withColumns({"_hint": hint, "_lh": F.lower(h), "_lu": F.lower(u)})
    for place, c in (("meta", F.col("_lh")), ("html", F.col("_lh")), ("url", F.col("_lu")), ("js", F.col("_lh"))):
        out = out.withColumn(f"_{place}", place_score(marks, place, c, best))
    guard = F.when((F.col("_hint.system") == "sixwool") & is_guard_page(h), F.struct(F.lit("sixwool").alias("system"), F.lit(GUARD_BONUS).alias("score")))
    out = out.withColumn("_guard", guard)
    weighted = [
        F.when(F.col(f"_{p}").isNotNull(), F.struct(F.col(f"_{p}.system").alias("system"), (F.col(f"_{p}.score") * w).alias("score")))
        for p, w in weights.items()
    ]
    parts = F.array_compact(F.array(F.col("_hint"), *weighted, F.col("_guard")))
    out = out.withColumn("_parts", parts).withColumn("_names", F.array_distinct(F.transform("_parts", lambda x: x["system"])))
    total = lambda n: F.aggregate(
        "_parts", F.lit(0.0), lambda a, x: a + F.when(x["system"] == n, x["score"]).otherwise(F.lit(0.0))
    )
    sums = F.transform("_names", lambda n: F.struct(n.alias("system"), F.round(total(n), 9).alias("score")))
    out = out.withColumn("_sums", sums)
    lead = F.aggregate("_sums", F.lit(None).cast(kind), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x).otherwise(a))
    out = out.withColumn("_lead", lead)
    hinted = F.try_element_at(F.filter("_sums", lambda x: x["system"] == F.col("_hint.system")), F.lit(1))
    out = out.withColumn("_h", hinted)
    take_hint = F.col("_hint").isNotNull() & (F.col("_h.score") >= F.col("_lead.score") * HINT_SHARE)
    sure = F.col("_lead.score") >= SURE
    system = F.when(take_hint, F.col("_hint.system")).otherwise(F.col("_lead.system"))
    top = F.when(take_hint & ~sure, F.col("_h.score")).otherwise(F.col("_lead.score"))
    # The least of nothing and one would be one.
    confidence = F.when(top.isNotNull(), F.least(top, F.lit(1.0)))
    confidence = F.when(take_hint, F.greatest(confidence, F.col("_hint.score"))).otherwise(confidence)
    confidence = F.coalesce(confidence, F.lit(0.0))
    return out.withColumns(
        {"confidence": confidence, "cms": F.when(confidence >= LIKELY, system)}
    ).drop("_lh", "_lu", "_hint", "_meta", "_html", "_url", "_js", "_guard", "_parts", "_names", "_sums", "_lead", "_h")


def census(detected: DataFrame) -> DataFrame:
    """Pages and mean confidence per system."""
    return detected.groupBy(F.coalesce("cms", F.lit("unknown")).alias("cms")).agg(
        F.count("*").alias("pages"), steady_mean(F.col("confidence"), 9).alias("avg_confidence")
    )


def is_confirmed(system: Column, url: Column, html: Column, marks=None) -> Column:
    """At least two of the places meta, html and url agree (one is enough where a system knows fewer)."""
    marks = marks or default_marks()
    groups = {p: _by_system(marks, p) for p in ("meta", "html", "url")}
    out = F.when(system == "sixwool", F.when(url.contains("6wool.ru") | F.lower(html).contains("6wool"), F.lit(True)))
    for name in dict.fromkeys(m.system for m in marks):
        known = [(p, groups[p][name]) for p in groups if name in groups[p]]
        hits = sum((_any_hit(F.lower(url if p == "url" else html), ps).cast("int") for p, ps in known), F.lit(0))
        need = 2 if len(known) >= 2 else 1
        out = out.when(system == name, hits >= need)
    return F.coalesce(out, F.lit(False))


def version_of(system: Column, html: Column, marks=None) -> Column:
    """First version pattern of the system that matches."""
    out = None
    for name, patterns in _by_system(marks or default_marks(), "version").items():
        found = F.coalesce(*[F.nullif(F.regexp_extract(html, "(?i)" + p, 1), F.lit("")) for p in patterns])
        out = F.when(system == name, found) if out is None else out.when(system == name, found)
    return out


def plugins_of(system: Column, html: Column, marks=None) -> Column:
    """Sorted distinct plug-ins, extensions and modules of the system."""
    out = None
    for name, patterns in _by_system(marks or default_marks(), "plugin").items():
        found = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(html, F.lit("(?i)" + p), F.lit(1)) for p in patterns]))))
        out = F.when(system == name, found) if out is None else out.when(system == name, found)
    return F.coalesce(out, F.array().cast("array<string>"))
