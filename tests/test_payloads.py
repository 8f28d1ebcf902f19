"""Vendor payloads: each text is read once, and odd entries keep their rows."""

from __future__ import annotations

from catalogwatch.operators import variants as O

OFFERS = [
    # A quoted object is an entry, a torn one is an unpriced offer; the first of equal names counts.
    (1, "bitrix", '{"OFFERS":["{\\"ID\\":2,\\"PRICE\\":3}",{"ID":1,"PRICE":4,"PRICE":5},"{bad",7,null]}'),
    # Prices and currencies in their order: what can't be read is passed over.
    (2, "bitrix", '{"OFFERS":[{"ID":1,"PRICE":"no","MIN_PRICE":{"VALUE":"12,5","CURRENCY":"RUB"}},{"ID":2,"PRICE":{"CURRENCY":""},"ITEM_PRICES":[{"X":1},{"PRICE":9,"CURRENCY":"EUR"}]}]}'),
    (3, "insales", '{"variants":[{"id":1,"title":"","option_values":[{"name":"N","title":"T"}]},{"id":2,"option_values":[],"option_name":"O","title":"},{"}]}'),
    (4, "insales", '{"variants":["{bad",{"id":3,"title":"\\u0022{"}]}'),
    (5, "magento", '{"attributes":{"1":{"label":"A","options":[5,{"id":1},{"id":2}]},"2":{"options":[{"id":3}]},"3":5}}'),
    (6, "insales", None), (7, None, '{"variants":[{"id":1}]}'),
]


def test_odd_payloads(spark):
    rows = spark.createDataFrame(OFFERS, "n int, v string, p string")
    got = O.payload_variants(rows, "v", "p", "n").select("n", "pos", "variation_id", "type", "value", "price", "currency")
    assert sorted((tuple(r) for r in got.collect()), key=str) == [
        (1, 0, "2", "variant", None, 3.0, None), (1, 1, "1", "variant", None, 4.0, None),
        (2, 0, "1", "variant", None, 12.5, "RUB"), (2, 1, "2", "variant", None, 9.0, None),
        (3, 0, "1", "N", "T", None, None), (3, 1, "2", "O", "},{", None, None),
        (4, 0, None, "variant", None, None, None), (4, 1, "3", "variant", '"{', None, None),
        (5, 0, "1", "a", "", 0.0, None), (5, 1, "2", "a", "", 0.0, None), (5, 2, "3", "attribute", "", 0.0, None),
    ]


def test_payloads_are_read_once(spark):
    """The readings of JSON in the plan: one for each place where an object may stand."""
    rows = spark.createDataFrame(OFFERS, "n int, v string, p string")
    plan = O.payload_variants(rows, "v", "p", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 20
    # No filter is inferred from the entries, which would read a payload again before it.
    assert "Filter (" not in plan
