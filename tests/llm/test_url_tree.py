"""The tree of templates against one in plain Python: any depth, wildcards, pooled siblings."""

import math
import random
import re
from collections import defaultdict

import pytest

from ledgerline.llm import url_filters as U


def like(n, bad, p):
    return n < 2 or abs(bad / n - p) <= U.SIMILAR_Z * math.sqrt(p * (1 - p) / n)


def smoothed(n, bad, p):
    return (bad + U.SMOOTHING * p) / (n + U.SMOOTHING)


def pools(unlike):
    """Unlike siblings in the order of their shares, those with equal counts together, added up while the next is like the pool."""
    out = []
    for own, n, bad in sorted({(b / n, n, b) for n, b in unlike}):
        times = unlike.count((n, bad))
        if out:
            a, c = out[-1]["n"], out[-1]["bad"]
            p = (c + bad) / (a + n)
            if abs(c / a - own) <= U.SIMILAR_Z * math.sqrt(p * (1 - p) * (1 / a + 1 / n)):
                out[-1]["n"], out[-1]["bad"] = a + n * times, c + bad * times
                out[-1]["members"].add((n, bad))
                continue
        out.append({"n": n * times, "bad": bad * times, "members": {(n, bad)}})
    return {m: (p["n"], p["bad"]) for p in out for m in p["members"]}


def tree(pages, labels):
    """(host, shape) -> (template, share), by walking down from the host."""
    shapes = defaultdict(lambda: [0, 0, 0])
    for page, host, path in pages:
        shape = tuple(re.sub("[0-9]+", "#", path.lstrip("/")).split("/"))
        at = shapes[host, shape]
        at[0] += 1
        if page in labels:
            at[1] += 1
            at[2] += labels[page]
    every = (sum(s[2] for s in shapes.values()) + 1) / (sum(s[1] for s in shapes.values()) + 2)
    out = {}

    def walk(host, some, node, depth, share):
        if len(some) == 1:
            (shape,) = some
            out[host, shape] = node + "".join(f"/{s}" for s in shape[depth:]), share
            return
        steps = defaultdict(dict)
        for shape, counts in some.items():
            steps["/" + shape[depth] if len(shape) > depth else ""][shape] = counts
        total = {k: [sum(c[i] for c in v.values()) for i in range(3)] for k, v in steps.items()}
        labelled = sum(t[1] for t in total.values())
        values = sum(k not in ("", "/") for k in steps) + any(k in ("", "/") for k in steps)
        varies = values > U.VARIABLE_VALUES and values > U.VARIABLE_SHARE * sum(t[0] for t in total.values())
        branches = defaultdict(dict)
        for step, shapes_ in steps.items():
            rare = step != "" and total[step][0] < U.OWN_PAGES and total[step][1] < U.OWN_LABELS
            branches["/*" if varies and rare else step].update(shapes_)
        sums = {b: [sum(c[i] for c in v.values()) for i in range(3)] for b, v in branches.items()}
        unlike = [(n, bad) for _, n, bad in sums.values() if not like(n, bad, share)]
        pooled = pools(unlike)
        for branch, shapes_ in branches.items():
            _, n, bad = sums[branch]
            own = share
            if not like(n, bad, share):
                n, bad = pooled[n, bad]
                own = share if n == labelled else smoothed(n, bad, share)
            if branch == "":                 # several shapes, where a wildcard is above
                for shape in shapes_:
                    out[host, shape] = node, own
            else:
                walk(host, shapes_, node + branch, depth + 1, own)

    hosts = defaultdict(dict)
    for (host, shape), counts in shapes.items():
        hosts[host][shape] = counts
    for host, some in hosts.items():
        n, bad = (sum(c[i] for c in some.values()) for i in (1, 2))
        walk(host, some, "", 0, every if like(n, bad, every) else smoothed(n, bad, every))
    return out


def made(seed):
    pick, pages, labels = random.Random(seed), [], {}
    for page in range(700):
        host = pick.choice(["a.com", "b.org", "c", ""])
        parts = ["", *pick.choices(["x", "y", "z", "", "news", "spam", f"s{pick.randrange(9)}t", chr(97 + pick.randrange(26)) * 2], k=pick.randrange(1, 4))]
        if host == "b.org":
            parts = ["", "deep", "er", "still", pick.choice(["", "p", "q"]), *parts[1:], "tail", "end"]
        path = "/".join(parts)
        pages.append((page, host, path))
        if pick.random() < 0.6:
            bad = 0.9 if "spam" in path else 0.5 if "/y" in path else 0.05
            labels[page] = int(pick.random() < bad)
    return pages, labels


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_against_plain_python(spark, seed):
    pages, labels = made(seed)
    found = U.templates(
        spark.createDataFrame(pages, "page_id long, host string, path string").repartition(3),
        spark.createDataFrame([(k, bool(v)) for k, v in labels.items()], "page_id long, bad boolean"))
    got = {(r["host"], tuple(r["shape"])): (r["template"], r["bad_share"]) for r in found.collect()}
    want = tree(pages, labels)
    assert got.keys() == want.keys()
    for key, (template, share) in want.items():
        assert got[key][0] == template, key
        assert math.isclose(got[key][1], share, rel_tol=1e-9), key


@pytest.mark.parametrize("length", [4, 60, 1000])
def test_turns_follow_branchings_not_segments(spark, monkeypatch, length):
    """Two pages of one host that part at their last segment."""
    turns = []
    settled = U.settled

    def counted(df, label, *rest):
        turns.append(label)
        return settled(df, label, *rest)

    monkeypatch.setattr(U, "settled", counted)
    stem = "/same" * (length - 1)
    pages = [(1, "trap", f"{stem}/good"), (2, "trap", f"{stem}/bad"), (3, "other", "/x")]
    found = U.templates(spark.createDataFrame(pages, "page_id long, host string, path string"),
                        spark.createDataFrame([], "page_id long, bad boolean"))
    assert sorted(r["template"] for r in found.collect()) == sorted(["/x", f"{stem}/good", f"{stem}/bad"])
    assert turns.count("url-level") == 1
