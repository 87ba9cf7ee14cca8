"""The scores of a rule ensemble against statistics and rules evaluated in plain Python."""

import math
import re
import statistics
import unicodedata

from entityframe.llm import quality_model
from entityframe.llm.quality_model import FEATURES, Model, Term
from entityframe.llm.text import STOP_WORDS

STOPS = {w for group in STOP_WORDS.values() for w in group}


def plain(text):
    """The eleven statistics of a text, in the order of the features."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words), len(text)
    share = lambda part, of: part / of if of > 0 else 0.0
    return [
        math.log1p(n),
        share(chars, n),
        math.log1p(max(map(len, words), default=0)),
        share(len(re.findall(r"[#*$%&|<>!?=+~^{}\[\]\\]", text)), n),
        share(sum(unicodedata.category(c) == "Lu" for c in text), chars),
        share(len(re.findall("[0-9]", text)), chars),
        share(sum(w.lower() in STOPS for w in words), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(n, len(lines)),
        share(sum(a == b for a, b in zip(words, words[1:])), n),
        share(len(set(words)), math.sqrt(n)),
    ]


def test_scores_match_a_plain_version(spark, make, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + n, t) for n, (_, t) in enumerate(odd_rows)]
    values = [plain(t) for _, t in rows]
    middles = [statistics.median(v[i] for v in values) + 1e-7 for i in range(len(FEATURES))]
    rules = [((Term(f, i % 2 == 0, middles[i]),), 0.3 * (i - 4)) for i, f in enumerate(FEATURES)]
    rules += [((Term(FEATURES[i], True, middles[i]), Term(FEATURES[i - 3], False, middles[i - 3])), -0.7 + 0.2 * i) for i in range(3, len(FEATURES))]
    model = Model(-0.25, tuple(rules))
    got = {r.doc_id: r for r in quality_model.score(make(rows, ["1 as score", "2 as label"]), model).collect()}
    at = {f: i for i, f in enumerate(FEATURES)}
    holds = lambda v, t: (v[at[t.feature]] <= t.threshold) == t.at_most
    seen = set()
    for (doc_id, _), v in zip(rows, values, strict=True):
        total = model.bias + sum(w for rule, w in rules if all(holds(v, t) for t in rule))
        want = 1 / (1 + math.exp(-total))
        assert abs(got[doc_id].score - want) < 1e-9 and got[doc_id].predicted == int(got[doc_id].score >= 0.3)
        seen.add(round(want, 6))
    assert len(seen) > 20
