"""Shares whose seventh digit is a half are rounded as SQL rounds them."""

import duckdb

from copse.plans import ensembles


class Halves:
    def __init__(self, counts, total):
        self.counts, self.total = counts, total

    def feature_importances(self):
        return [n / self.total for n in self.counts]


def test_boost_importances_rounds_halves_as_sql(spark, sf_dir, monkeypatch):
    total = 108_000_000  # the rows over the levels of 4 trees of 3 levels and 9,000,000 rows
    counts = [54 + 108 * 97 * k for k in range(300)]
    monkeypatch.setattr(ensembles, "_boosted", lambda *a, **kw: (None, Halves(counts, total)))
    got = {r["feature"]: r["importance"] for r in ensembles.boost_importances(spark, sf_dir).collect()}
    want = dict(duckdb.execute(f"SELECT i, round((54 + 108 * 97 * i)::BIGINT / {total}::BIGINT, 6) FROM range(0, 300) t(i)").fetchall())
    assert got == want
    assert any(round(n / total, 6) != want[k] for k, n in enumerate(counts))
