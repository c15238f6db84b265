"""Bootstrapped identifiers that hold blanks, or are long."""

from pyspark.sql import functions as F

from gaugeline.llm import pii

CARDS = ["4111 1111 1111 1111", "4012 8888 8888 1881", "5555 5555 5555 4444", "5105 1051 0510 5100", "4222 2222 2222 2220", "6011 1111 1111 1117"]


def test_unseen_identifiers_with_blanks_and_long_ones(spark):
    long_ = "x" * 80 + "@intern"
    far = "w" * 70
    rows = [(i, f"please reach me at +1 (017) 555-77{i} soon") for i in range(10, 70)]
    rows += [(100 + i, f"my card number is {c} thanks") for i, c in enumerate(CARDS * 1)]
    rows += [(300 + i, f"send it mail to u{i}@ex.com now") for i in range(60)]
    rows += [(500 + i, f"the {far} for {i}.1.2.3 now") for i in range(60)]
    new = {900: ("reach me at (017) 555-7713, please", [("phone", "(017) 555-7713")]), 901: ("the card number is 4111 1111 1111 1112.", [("card", "4111 1111 1111 1112")]), 902: ("send mail to " + long_ + " now", [("email", long_)]), 903: (f"the {far} for 1.2.3.999 now", [("ip", "1.2.3.999")]), 904: ("we were at (017) 555-7713 and 12 34", []), 905: ("reach me at (4111 1111 11)", [("phone", "4111 1111 11")])}
    df = spark.createDataFrame(rows + [(k, t) for k, (t, _) in new.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df, confidence=0.8).filter("doc_id >= 900").collect()}
    for k, (text, want) in new.items():
        assert [(pii.KINDS[s.kind], text[s.start : s.stop]) for s in got[k].spans] == want, k
    assert pii.redact(df, confidence=0.8).filter("doc_id = 900").select(F.col("text")).first().text == "reach me at [PHONE], please"
