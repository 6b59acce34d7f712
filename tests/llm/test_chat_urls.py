"""Chat repair against all ways to repair, and link-graph verdicts against a plain propagation."""
import itertools
import random
from collections import Counter, defaultdict

import pytest

from sluice.llm import chat_repair as chat
from sluice.llm import url_trust
from sluice.llm.queries import URL_RULES

COSTS = chat.Costs()


def cheapest(roles):
    """Least cost over every choice of target roles, with merges or fillings between."""
    relabel = {(a, b): c for a, b, c in COSTS.relabel}

    def gap(a, b):
        if a is None:
            return {"system": 0, "user": 0, "assistant": COSTS.insert}[b]
        if a == b:
            return min(COSTS.merge, COSTS.insert if a != "system" else 99)
        if b == "system":
            return 99
        return {("system", "user"): 0, ("system", "assistant"): COSTS.insert, ("user", "assistant"): 0, ("assistant", "user"): 0}[a, b]
    best = 0 if not roles else 1 << 30
    for target in itertools.product(chat.ROLES, repeat=len(roles)):
        cost = sum(0 if r == t else COSTS.unknown if r not in chat.ROLES else relabel.get((r, t), 1 << 20) for r, t in zip(roles, target))
        cost += sum(gap(a, b) for a, b in zip((None, *target), target))
        best = min(best, cost + {"system": 2, "user": 1, "assistant": 0}[target[-1]] * COSTS.insert)
    return best


def conversations(seed):
    rng = random.Random(seed)
    pool = ["system", "user", "assistant", "user", "assistant", None, "tool"]
    return {c: [rng.choice(pool) for _ in range(rng.randint(1, 6))] for c in range(120)}


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return roles == ["user", "assistant"] * (len(roles) // 2) and bool(roles)


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_repair_is_cheapest_and_legal(spark, chunk):
    given = conversations(chunk)
    rows = [(c, t, r, f"text {c} {t}") for c, roles in given.items() for t, r in enumerate(roles)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), chunk_turns=chunk).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id, r.row, r.slot)):
        by[r.conv_id].append(r)
    for c, roles in given.items():
        out = by[c]
        assert {r.cost for r in out} == {cheapest(roles)}, roles
        assert [r.source_role for r in out if r.slot == 9] == roles
        assert legal([r.role for r in out if r.action != "merge"]), roles
        text = "".join(r.rendered for r in out)
        turns = text.split("\n<|end|>\n")
        assert turns.pop() == "" and [t.split("|>")[0][2:] for t in turns] == [r.role for r in out if r.action != "merge"]
        assert all(f"text {c} {t}" in text for t in range(len(roles)))


def test_one_long_conversation_is_spread_and_exact(spark):
    rng = random.Random(2)
    roles = [rng.choice(["user", "assistant", "user", "system"]) for _ in range(3000)]
    frame = spark.createDataFrame([(1, t, r, "x") for t, r in enumerate(roles)] + [(2, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    costs = [{r.cost for r in chat.repair(frame.repartition(n), chunk_turns=c).filter("conv_id = 1").collect()} for n, c in ((1, 10_000), (8, 100))]
    assert costs[0] == costs[1] and len(costs[0]) == 1


def test_chunks_and_partitions_change_nothing(spark):
    """Of several cheapest repairs the same one is chosen, however the rows are cut."""
    rng = random.Random(11)
    given = {c: [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(1, 14))] for c in range(400)}
    frame = spark.createDataFrame([(c, t, r, "x") for c, roles in given.items() for t, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = []
        for chunk, parts in ((512, 1), (1, 8), (3, 3), (5, 8)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got.append(sorted(map(tuple, chat.repair(frame, chunk_turns=chunk).drop("part").collect()), key=str))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1] == got[2] == got[3]
    # and that one is the path that one pass over the conversation takes
    automaton = chat.Automaton(COSTS)
    roles = {c: [r[4] for r in sorted((x for x in got[0] if x[0] == c and x[2] == 9), key=lambda x: x[1])] for c in given}
    for c, source in given.items():
        known = chat.known_roles(source)
        last = int((automaton.after(known, chat.begun()) + automaton.ending).argmin())
        assert roles[c] == [chat.ROLES[s - 1] for s in automaton.trace(known, chat.begun(), last)[1:]]


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, row string, part string, cost string"
    rows = [(None, 0, "user", "a"), (None, 1, None, None), (1, None, None, ""), (1, None, "user", "b" * 3_000_000), (2, 5, "user", "c"), (2, 5, "user", "c"), (3, 0, "system", None)]
    got = chat.repair(spark.createDataFrame([(*r, "", "", "") for r in rows], schema)).collect()
    assert Counter(r.conv_id for r in got if r.slot == 9) == Counter(r[0] for r in rows)
    assert [r.action for r in sorted(got, key=lambda r: (r.row, r.slot)) if r.conv_id == 2] == ["keep", "merge", "insert"]
    assert chat.repair(spark.createDataFrame([], schema)).count() == 0


def plain_judge(pages, rounds):
    unit, follow = url_trust.UNIT, url_trust.FOLLOW

    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        return host, rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]

    def rule(host, path):
        fit = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    edges, share = defaultdict(Counter), defaultdict(Counter)
    for _, url, links in pages:
        host, path = parse(url)
        found = rule(host, path)
        share[host]["n"] += 1
        share[host][found and found[0]] += 1
        for link in links:
            to = host if "://" not in link and not link.startswith("//") else parse("x:" + link if link.startswith("//") else link)[0]
            if to and not link.startswith("mailto:"):
                edges[host][to] += 1
                share[to]
    s = {h: c["allow"] * unit // c["n"] if c["n"] else 0 for h, c in share.items()}
    b = {h: c["block"] * unit // c["n"] if c["n"] else 0 for h, c in share.items()}
    for h in share:
        if not edges[h]:
            edges[h][h] = 1
    p = {h: {g: n * unit // sum(e.values()) for g, n in e.items()} for h, e in edges.items()}
    t, d = dict(s), dict(b)
    for _ in range(rounds):
        t, d = ({h: (s[h] * (100 - follow) + sum(t[g] * p[g].get(h, 0) // unit for g in share) * follow) // 100 for h in share},
                {h: (b[h] * (100 - follow) + sum(d[g] * q // unit for g, q in p[h].items()) * follow) // 100 for h in share})
    out = Counter()
    for i, url, _ in pages:
        host, path = parse(url)
        found = rule(host, path)
        verdict = found[0] if found else "block" if d[host] - t[host] >= url_trust.THRESHOLD * unit else "allow"
        out[i, host, path, found and found[1] + found[2], verdict, t[host] / unit, d[host] / unit] += 1
    return out


def test_link_graph(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.example.{e}" for i in range(12) for e in ("net", "com", "org", "edu")] + ["Good.EDU"]
    pages = []
    for i in range(400):
        host = rng.choice(hosts)
        paths = ["/de/1", "/", "/x", "/en/1"] if host.endswith("net") else ["/en/1", "/de/2?x=/fr/", "/fr/3#/", "", "/", "?q"]
        url = f"https://{host}{rng.choice(paths)}"
        to = [f"//{rng.choice(hosts)}/de/1" if rng.random() < 0.2 else f"http://{rng.choice(hosts)}/a" if rng.random() < 0.5 else "/rel" for _ in range(0 if host.endswith("net") else rng.randint(0, 4))]
        pages.append((i, url, to + ["mailto:a@b"] * (i % 3 == 0)))
    pages += [(400 + i, "https://trap.edu/x", [f"https://h{j}.example.net/de/{i}" for j in range(12)]) for i in range(5)]
    pages += [(500, None, []), (501, "no host", ["/x"]), (502, "", []), (503, "a://b://c/d", ["https://b:/"]), (0, pages[0][1], pages[0][2])]
    html = [(i, u, None if i == 500 else "<a HREF = '" + "'></a><a href=\"/\"></a><A href='".join(x) + "'>" if x else "", "x", "y") for i, u, x in pages]
    want = [(i, u, [y for k, y in enumerate(z for link in x for z in (link, "/")) if k < 2 * len(x) - 1]) for i, u, x in pages]
    frame = spark.createDataFrame(html, "page_id long, url string, html string, host string, src string").repartition(5)
    got = url_trust.judge(frame, URL_RULES)
    rows = got.select("page_id", "__host", "__path", "__rule", "__verdict", "__trust", "__distrust").collect()
    expected = plain_judge(want, url_trust.ROUNDS)
    assert Counter(tuple(r) for r in rows) == expected
    assert any(v[4] == "block" and v[3] is None for v in expected), "propagation blocks a host without rules"
    assert got.columns[:5] == frame.columns and url_trust.judge(frame.limit(0), URL_RULES).count() == 0
