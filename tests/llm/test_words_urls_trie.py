"""Spelling variants, url filter and prefix trie against plain definitions."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from counterfoil.llm import prefix_trie, spelling_groups, url_filter
from counterfoil.llm.queries import SITES
from counterfoil.llm.url_filter import Rule


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Spelling variants


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants_of_a_small_alphabet(spark):
    draw = random.Random(5)
    counts = {"".join(draw.choice("abcé") for _ in range(draw.randint(3, 6))): draw.randint(1, 60) for _ in range(400)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    for parts in (4, 8):
        assert rows(spelling_groups.spelling_groups(frame, parts=parts)) == variants(counts)


def test_double_letters_and_ties(spark):
    counts = {"tree": 9, "treee": 4, "tre": 4, "free": 18, "three": 1, "bree": 18, "alone": 3}
    got = rows(spelling_groups.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == variants(counts)
    assert ("tree", "bree", "bree", 9, 4 + 1, 18) in got and ("alone", None, "alone", 3, 0, None) in got


def test_vocabulary_with_slips(spark, docs, texts, empty):
    import re

    want = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert dict(map(tuple, spelling_groups.vocabulary(docs).collect())) == want
    got = spelling_groups.spelling_groups(spelling_groups.vocabulary(empty))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


# Url filter


def parts(url):
    start = (url or "").find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def rule_of(host, path, rules):
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fitting, key=lambda r: (-len(r.site), -len(r.host), r.site), default=None)


def verdicts(pages, rules, fold, order):
    """[(page_id, host, path, rule, verdict)] with all counts made anew for each model."""
    urls = [(i, *parts(u)) for i, u in pages]
    of = {(h, p): rule_of(h, p, rules) for _, h, p in urls}
    weight = collections.Counter((h, p) for _, h, p in urls if h or p)

    def model(verdict, left_out):
        seen, kinds, total = collections.Counter(), collections.defaultdict(set), collections.Counter()
        for (h, p), n in weight.items():
            r = of[h, p]
            if r and r.verdict == verdict and fold[h, p] != left_out:
                s = "\x02" * order + h + p + "\x03"
                for k in range(order, len(s)):
                    for o in range(order + 1):
                        context = s[k - o : k]
                        seen[context, s[k]] += n
                        kinds[context].add(s[k])
                        total[context] += n

        def chance(context, c):
            out = 1 / 256
            for o in range(order + 1):
                tail = context[order - o :]
                if total[tail]:
                    out = (seen[tail, c] + len(kinds[tail]) * out) / (total[tail] + len(kinds[tail]))
            return out

        return chance

    models = {f: (model("allow", f), model("block", f)) for f in (None, 0, 1)}
    score = {}
    for h, p in weight:
        s = "\x02" * order + h + p + "\x03"
        a, r = models[fold[h, p] if of[h, p] else None]
        logs = [round(math.log(a(s[k - order : k], s[k]) / r(s[k - order : k], s[k])) * 1e6) for k in range(order, len(s))]
        score[h, p] = sum(logs) / len(logs)
    known = {v: [(score[a], n) for a, n in weight.items() if of[a] and of[a].verdict == v] for v in ("allow", "block")}
    least = None
    if known["allow"] and known["block"]:
        share = lambda pairs, test: sum(n for s, n in pairs if test(s)) / sum(n for _, n in pairs)
        tried = [(share(known["allow"], lambda s: s < 10000 * k) + share(known["block"], lambda s: s >= 10000 * k), abs(k), -k) for k in range(-600, 601)]
        least = -min(tried)[2] * 10000
    out = []
    for i, h, p in urls:
        r = of[h, p]
        own = "block" if (h or p) and least is not None and score[h, p] < least else "allow"
        out.append((i, h, p, r.site if r else None, r.verdict if r else own))
    return sorted(out, key=str)


def check_urls(spark, pages, rules, order):
    frame = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS n", "'y' AS verdict")
    addresses = spark.createDataFrame(list({parts(u) for _, u in pages}), "host string, path string")
    fold = {(r.host, r.path): r.f for r in addresses.selectExpr("*", "pmod(xxhash64(host, path), 2) AS f").collect()}
    got = rows(url_filter.judged(frame, rules, order).drop("score"))
    assert got == verdicts(pages, rules, fold, order)
    return {r[0]: r[4] for r in got}


def test_urls(spark):
    draw = random.Random(3)
    pages = []
    for i in range(160):
        host = draw.choice(["Good.example.org", "fine.example.org", "casino.example.com", "a.b.net", "example.net", "other.example.com"])
        path = draw.choice(["/en/", "/de/", "/fr/", "/fr", "/de/win/"]) + str(draw.randint(0, 999))
        pages.append((i, f"https://{host}{path}{draw.choice(['', '?q=/fr/', '#top'])}"))
    pages += [(200, None), (201, ""), (202, "no scheme"), (203, "http://"), (204, "x://net"), (205, "x://NET/en/é🙂"), (205, "x://NET/en/é🙂"), (None, "x://a?b://c/d")]
    pages.append((206, "http://long.example.org/" + "ab/" * 3000))
    check_urls(spark, pages, SITES, 5)
    check_urls(spark, pages, SITES[:2], 2)


def test_the_model_tells_hosts_apart(spark):
    pages = [(i, f"http://poker{i % 7}.example.com/de/{i}") for i in range(40)] + [(100 + i, f"http://library{i % 7}.example.org/fr/{i}") for i in range(40)]
    pages += [(300, "http://poker9.example.info/x"), (301, "http://library9.example.info/x")]
    got = check_urls(spark, pages, SITES, 5)
    assert (got[300], got[301]) == ("block", "allow")


def test_no_table_of_urls_or_strings_is_sent_to_all_tasks(spark, monkeypatch):
    """Spark takes the strings of urls for as small as their packed urls and would broadcast them; at size they don't fit the driver."""
    plans, kept = [], url_filter.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return kept(df)

    monkeypatch.setattr(url_filter, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        pages = [(i, f"http://host{i % 9}.example.{'com/de' if i % 2 else 'org/fr'}/{i}") for i in range(400)]
        judged = url_filter.judged(spark.createDataFrame(pages, "page_id long, url string"), SITES)
        assert judged.count() == 400
        plans.append(judged._jdf.queryExecution().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(plan.count("SortMergeJoin") for plan in plans) == 14
    assert not any("Broadcast" in plan for plan in plans)


@pytest.mark.parametrize("rules", [SITES, [Rule("net/", "block")], []])
def test_urls_without_examples_of_both_kinds_are_allowed(spark, rules):
    pages = [(1, "http://a.net/x"), (2, "http://b.info/y")]
    got = check_urls(spark, pages, rules, 3)
    assert got == {1: "block" if rules else "allow", 2: "allow"}
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


# Prefix trie


def trie(turns, group=5, most=9):
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, steps in own.items():
        h = zlib.crc32(str(c).encode()) % most
        leader = c - int(math.fmod(c, group))
        built[c] = own.get(leader, [])[:h] + steps[h:]
    members = collections.defaultdict(list)
    for c, steps in built.items():
        for d in range(len(steps) + 1):
            members[tuple(steps[:d])].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [totals[c] for c in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
        ends = sorted(c for c in members[node] if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), *totals[node], digest))
    return sorted(out, key=str)


KINDS = "conv_id long, turn long, role string, text string, x string, depth string, n string"


def turn_frame(spark, turns):
    return spark.createDataFrame([(*t, "a", "b", "c") for t in turns], KINDS)


@pytest.fixture(scope="module")
def turns():
    draw = random.Random(11)
    out = [(c, t, draw.choice(["user", None]), draw.choice(["", None, "é🙂", "same", "other " * 40])) for c in range(120) for t in range(draw.randint(1, 9))]
    out += [(c, 0, "user", "hello") for c in range(200, 260)]
    out += [(c, t, "user", "copy") for c in range(300, 330) for t in range(12)]
    out += [(-7, 1, "user", "minus"), (-5, 1, "user", "leader"), (None, 1, "user", "no id"), (400, None, "user", "first"), (400, 1, "b", "tie"), (400, 1, "a", "tie")]
    out += [(500, 1, "user", "twice"), (500, 1, "user", "twice"), (601, 1, "user", "x" * 100000)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("share, limit", [(None, 1 << 18), (40, 3), (3, 2), (1, 1)])
def test_trie(spark, turns, share, limit):
    assert rows(prefix_trie.prefix_trie(turn_frame(spark, turns), share, limit)) == trie(turns)


def test_trie_of_long_conversations(spark, monkeypatch):
    """One conversation holds most of the turns; it is numbered by ranges and summed in blocks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    turns = [(c, t, "user", str(t % 7)) for c in (5, 6, 7) for t in range(400)] + [(8, 0, "user", "0")]
    assert rows(prefix_trie.prefix_trie(turn_frame(spark, turns), 2)) == trie(turns)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(turn_frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turn_frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_messages_come_in_order_from_memory_and_disk():
    draw = random.Random(1)
    sent = [(draw.randint(-5, 0), draw.randint(0, 3), draw.randint(0, 3), k, 0) for k in range(500)]
    queue = prefix_trie.Messages(limit=7)
    for message in sent:
        queue.push(message)
    got = [m for key in sorted({m[:3] for m in sent}) for m in queue.take(key)]
    assert got == sorted(sent) and len(queue.runs) > 10
