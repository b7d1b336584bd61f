"""Loose formats in texts without a digit or an @."""

import re

from pyspark.sql import functions as F

from sievework.llm import pii

SPELLED = ["mueller(at)mail.com", "anna [at] uni.de", "info at mail.org", "anna at mail[.]com", "info AT mail.org", "mueller[AT]mail(dot)com"]


def test_candidates_do_not_hang_on_a_digit(spark, redactor):
    """An unrelated digit further on changes neither the candidates nor what the trees add."""
    texts = [f"please write to {x} soon{tail}" for x in SPELLED for tail in (" or", " 7")]
    texts += [f"the host {x} is up{tail}" for x in ("fe:dc:ba:ab:cd:ef:fa:ce", "abc:def:fed::cab") for tail in (" or", " 7")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.personal_data(df, redactor).join(df.select(F.col("doc_id").alias("id"), F.expr(pii.loose_spans()).alias("loose")), F.col("row.doc_id") == F.col("id"))
    rows = {r["id"]: r for r in found.select("id", "loose", "added").collect()}
    hits = lambda i, c: [(s["kind"], s["start"], s["end"]) for s in rows[i][c]]
    for i in range(0, len(texts), 2):
        assert hits(i, "loose") == hits(i + 1, "loose"), texts[i]
        assert hits(i, "added") == hits(i + 1, "added"), texts[i]
    assert [s["hit"] for s in rows[0]["added"]] == ["mueller(at)mail.com"]


def test_needs_hold_for_every_match(spark):
    """Each candidate of the plain patterns is one of the guarded ones."""
    texts = [*SPELLED, "a@b.de", "a [@] b.de", "a( @ )b.de", "at noon", "fe:dc:ba:ab", "::", "1[.]2[.]3[.]4", "4111.1111.1111.1111", "(415) 555-0134", "that (at) x"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = F.concat(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(0)) for _, pattern, _ in pii.LOOSE])
    got = df.select("text", plain.alias("plain"), F.transform(F.expr(pii.loose_spans()), lambda s: s["hit"]).alias("guarded")).collect()
    assert all(r["plain"] == r["guarded"] for r in got)
    assert sum(bool(r["plain"]) for r in got if not re.search("[0-9@]", r["text"])) >= 5
