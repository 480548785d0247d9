"""The toxicity model against a plain version; its paths for small and large models agree."""

import math
import random
from collections import Counter

import pytest

np = pytest.importorskip("numpy")

from massweave.llm import kneser_ney as k  # noqa: E402


def plain_ratio(texts, order=k.ORDER):
    """word -> log-likelihood difference, by dictionaries."""
    grams = (Counter(), Counter())
    for text, label in texts:
        for w in text.split():
            s = "\0" * order + w.lower() + "\0"
            grams[label].update(s[i - order + 1 : i + 1] for i in range(order, len(s)))
    level, below = set(grams[0]) | set(grams[1]), {}
    counts = {}
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[-o:] for g in level)
        level = set(counts[o])
    for o in range(1, order):
        d, e = Counter(), Counter()
        for g, s in counts[o].items():
            d[g[:-1]] += s
            e[g[:-1]] += 1
        below = {g: max(s - k.DISCOUNT, 0) / d[g[:-1]] + k.DISCOUNT * e[g[:-1]] / d[g[:-1]] * (1 / (len(counts[1]) + 1) if o == 1 else below[g[1:]]) for g, s in counts[o].items()}
    total, types = (Counter(), Counter()), (Counter(), Counter())
    for label in (0, 1):
        for g, n in grams[label].items():
            total[label][g[:-1]] += n
            types[label][g[:-1]] += 1

    def chance(label, g):
        share = min(k.DISCOUNT * types[label][g[:-1]], total[label][g[:-1]]) + k.PRIOR
        seen = g in grams[0] or g in grams[1]
        return (max(grams[label][g] - k.DISCOUNT, 0) + share * (below[g[1:]] if seen else 1)) / (total[label][g[:-1]] + k.PRIOR)

    def ratio(w):
        s = "\0" * order + w.lower() + "\0"
        return sum(math.log(chance(1, s[i - order + 1 : i + 1]) / chance(0, s[i - order + 1 : i + 1])) for i in range(order, len(s)))

    return ratio


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    word = lambda: "".join(random.choice("abcdé") for _ in range(random.randint(1, 8)))
    own = ([word() for _ in range(60)], [word() for _ in range(60)])
    return [(" ".join(random.choices(own[0] + own[label][:9], k=20)), label) for label in (0, 1) for _ in range(30)]


@pytest.mark.parametrize("in_task", [k.TASK_GRAMS, 0])
def test_ratios_by_dictionaries(spark, texts, in_task):
    found = k.ratios(k.count_grams(spark.createDataFrame(texts, "text string, label int")), in_task)
    model = k.look_ups(k.held_in_memory(found).value)
    plain = plain_ratio(texts)
    words = sorted({w for t, _ in texts for w in t.split()}) + ["zzz", "abx", "É", "a"]
    got, size = k.log_ratio(model, words)
    assert np.allclose(got, [plain(w) for w in words], atol=1e-4) and size.tolist() == [len(w) + 1 for w in words]


def test_joined_scores_are_those_of_look_ups(spark, texts):
    rows = [(i, t) for i, (t, _) in enumerate(texts)] + [(900, None), (901, ""), (902, "unknown Ω words"), (0, texts[0][0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    one, two = k.train(d, labels), k.train(d, labels, rows_in_memory=0)
    assert one["lookups"] is not None and two["lookups"] is None
    score = lambda m: sorted((r.doc_id, round(r.score, 6)) for r in k.rate(d, m).collect())
    assert score(one) == score(two) and len(score(one)) == len(rows)
    assert sorted(r.doc_id for r in k.harmless(d, one).collect()) == sorted(r.doc_id for r in k.harmless(d, two).collect())
