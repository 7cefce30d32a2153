"""Template phrases against a plain count."""

from collections import Counter

from wardline.operators import corpus as c


def test_template_phrases_against_a_plain_count(spark):
    texts = ["The pump was found open. The pump was found shut! ok", "the pump was found  open. a b. one two three", "", None, "The pump was found open"]
    want = Counter()
    for text in texts:
        for s in (text or "").lower().replace("!", ".").split("."):
            w = s.split()
            if len(s.strip()) > 5:
                want.update([("prefix", " ".join(w[:4])), ("suffix", " ".join(w[-4:]))] if len(w) >= 4 else [])
                want.update(("trigram", " ".join(w[i : i + 3])) for i in range(len(w) - 2))
    out = c.template_phrases(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 100, 0, 0)
    assert {(r.kind, r.phrase): r.n for r in out.collect()} == want
    ranks = sorted((r["rank"], r.n) for r in out.filter("kind = 'trigram'").collect())
    assert [x for x, _ in ranks] == list(range(1, len(ranks) + 1)) and ranks == sorted(ranks, key=lambda x: (-x[1], x[0]))
    assert "lambdafunction" not in out._jdf.queryExecution().analyzed().toString()  # nothing is interpreted for each run of words
