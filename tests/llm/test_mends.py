"""Faults found in review: each test fails on the code before its mend."""

import gzip
import math
import random
import time
from collections import defaultdict

import pytest

pytest.importorskip("numpy")

from massweave.llm import html_density, pii_bootstrap, warc_derivatives  # noqa: E402


def plain_rounds(edges, trust, seeds):
    """Weights of the trusted patterns after many plain rounds. edges: {(kind, pattern): {instance: seed}}."""
    good = {}
    for _ in range(400):
        found = defaultdict(float)
        for (kind, p), w in good.items():
            for i, seed in edges[kind, p].items():
                if not seed:
                    found[kind, i] += math.log(1 - w)
        now = {}
        for (kind, p), own in edges.items():
            n = sum(own.values())
            sure = n + sum(1 - math.exp(found[kind, i]) for i, seed in own.items() if not seed and (kind, i) in found)
            if n >= seeds and sure >= trust * len(own):
                now[kind, p] = sure / (len(own) + 1)
        good = now
    return good


def test_rounds_go_on_while_weights_grow(spark):
    case = {(0, "a"): dict.fromkeys(["s1", "s2", "s3", "s4"], True) | {"u": False}, (0, "b"): dict.fromkeys(["t1", "t2", "t3", "t4"], True) | {"v": False}}
    case[0, "c"] = dict.fromkeys(["r1", "r2", "r3", "r4", "r5"], True) | {"u": False, "v": False, "w": False}
    random.seed(2)
    other = {(1, f"p{k}"): {f"i{random.randrange(40)}": j < 4 for j in range(6)} for k in range(30)}
    edges = case | other
    rows = [(kind, p, i, seed) for (kind, p), own in edges.items() for i, seed in own.items()]
    got = pii_bootstrap.trusted_patterns(spark.createDataFrame(rows, "kind int, pattern string, instance string, seed boolean"))
    weights = {(r.kind, r.pattern): r.weight for r in got.collect()}
    want = plain_rounds(edges, pii_bootstrap.TRUST, pii_bootstrap.SEEDS)
    assert set(weights) == set(want) and {(0, "a"), (0, "b"), (0, "c")} <= set(weights)
    assert all(abs(weights[k] - want[k]) < 1e-4 for k in want)


def test_long_identifiers_are_candidates():
    text = "id " + "ab1" * 60 + " end"
    assert (pii_bootstrap.ANY, 3, 183) in pii_bootstrap.loose_spans(text, [])


def test_records_of_any_spelling_are_read():
    whole = warc_derivatives.response("http://a.example/", "<p>one</p>", 1)
    lower = whole.replace(b"WARC-Type", b"warc-type").replace(b"Content-Length: ", b"content-length:", 1)
    want = [b for _, b in warc_derivatives.derive(whole)]
    assert len(want) == 2
    assert [k for k, _ in warc_derivatives.derive(lower)] == ["metadata", "conversion"] and warc_derivatives.derive(whole + b"\n")
    other = warc_derivatives.response("http://b.example/", "<p>two</p>", 2)
    assert [b for _, b in warc_derivatives.derive(whole + b"\r\n" + other)] == want + [b for _, b in warc_derivatives.derive(other)]
    assert [b for _, b in warc_derivatives.derive(gzip.compress(whole) + gzip.compress(other))] == want + [b for _, b in warc_derivatives.derive(other)]


def test_what_is_no_record_is_counted(spark):
    whole = warc_derivatives.response("http://a.example/", "<p>one</p>", 1)
    rows = [(1, bytearray(b"junk\r\n" + whole + whole[:40])), (2, bytearray(whole[:-20])), (3, None), (4, bytearray(b"")), (5, bytearray(gzip.compress(whole)[:60]))]
    records = spark.createDataFrame(rows, "page_id long, record binary")
    assert sorted((r.page_id, r.warc_type) for r in warc_derivatives.derivatives(records).collect()) == [(1, "conversion"), (1, "metadata")]
    lost = {r.page_id: (r.runs, r.n_bytes) for r in warc_derivatives.unreadable(records).collect()}
    assert lost[1] == (2, 46) and lost[2] == (1, len(whole) - 20) and lost[3] == lost[4] == (0, 0) and lost[5][0] <= 1


@pytest.mark.parametrize("shape", [lambda n: "<div>" * n + "<td>x</td>" * n, lambda n: "<b>" * n + "<div>" * n, lambda n: "<ul>" * n + "<td>x</td>" * n, lambda n: "<b><div>" + "<i>x</b>" * n, lambda n: "<p>" + "<i>" * n + "</p>x" * n])
def test_pages_of_open_tags_take_linear_time(shape):
    def took(n):
        t = time.process_time()
        html_density.main_text(shape(n))
        html_density.visible_text(shape(n))
        return time.process_time() - t

    took(500)
    assert took(16000) < 24 * max(took(2000), 0.02)


def test_lists_and_inline_ends_as_before():
    assert html_density.visible_text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert html_density.visible_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert html_density.visible_text("<b>x<div>y</b>z</div>w") == "x\nyz\nw"
    assert html_density.visible_text("<dl><dt>a<dd>b<dt>c</dl><p>d<p>e") == "a\nb\nc\nd\ne"
