"""The whole batch build on landed domain files."""

from __future__ import annotations

import datetime as dt

from reviewlake import build, schemas


def test_build_writes_every_table(spark, tmp_path):
    offers, reviews = [], []
    words = {0: "matte red lipstick long lasting", 1: "glossy red lipstick shine",
             2: "hydrating face serum", 3: "vitamin face serum glow"}
    cats = {0: "Lipstick", 1: "Lipstick", 2: "Serum", 3: "Serum"}
    for p in range(4):
        offers.append((f"s{p}", "$10.00", f"/product/x-P{p}?skuId=s{p}",
                       {"imageUrl": f"/i/{p}.jpg?a=1"}, "30 mL", f"Name{p}", "Acme",
                       f"<p>{words[p]}</p>", "Makeup", "Lips", cats[p], 5, 10, 4.0,
                       dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)))
        for i in range(30):
            good = i % 2 == 0
            reviews.append((f"c{p}-{i}", None, "en_US", False, 5 if good else 1, good, None,
                            "t", "love it great" if good else "awful hate it", False,
                            f"https://api.example.com/r.json?Filter=ProductId%3AP{p}&offset=0",
                            {"age": "18to24"}))
    spark.createDataFrame(offers, schemas.OFFER).write.parquet(str(tmp_path / "offers"))
    spark.createDataFrame(reviews, schemas.REVIEW).write.parquet(str(tmp_path / "reviews"))
    paths = build.run(spark, str(tmp_path / "offers"), str(tmp_path / "reviews"),
                      str(tmp_path / "out"))
    got = {k: spark.read.parquet(v) for k, v in paths.items()}
    assert got["catalog"].count() == 4 and got["enriched"].count() == 4
    assert got["profile"].where("age__18to24 = 30").count() == 4
    s = got["sentiment"].collect()
    assert sum((r["sentiment__BadSentiment"] or 0) + (r["sentiment__GoodSentiment"] or 0)
               for r in s) == 120
    recos = {(r.prod_id, r.rank): r.reco_id for r in got["recommendations"].collect()}
    assert recos[("P0", 1)] == "P1" and recos[("P2", 1)] == "P3"
