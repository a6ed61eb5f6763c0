import math
import random
import re

from curata.llm import urls


def split(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(h, p):
    fit = [(len(t), t, a) for a, t in urls.RULES if (h == t.partition("/")[0] or h.endswith("." + t.partition("/")[0])) and p.startswith("/" + t.partition("/")[2])]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "nourl", "http://x.net", "http://x.NET/a", "https://a.example.net/en/1?x=2#y", "http://EXAMPLE.com/de/?q", "http://notexample.com/de/", "http://x.org/fr/é", "ftp://goodbad.example.com/en/story-7",
        "http://a?b/c", "a://b://c/d", "http://" + "long" * 40 + ".com/" + "p" * 30_000, "http://x.org/de/", "http://badgood.info/story/good", "http://..//", "http://x.net\n/a"]


def test_parts_rules_and_verdicts(spark):
    html = "<html><script>bad bad</script><p>good bad story good</p></html>"
    rows = [(k, u, html, "z") for k, u in enumerate(URLS * 3)] + [(None, "http://x.net/a", None, "z")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), urls.RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        u = "http://x.net/a" if r.page_id is None else rows[r.page_id][1]
        h, p = split(u)
        text, action = rule(h, p)
        assert (r.host, r.path, r.rule) == (h, p, text), u
        assert r.verdict == (action or ("block" if r.score > 0 else "allow"))
    assert any(r.host_words.startswith("good bad ") for r in out)
    empty = urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), urls.RULES)
    assert empty.count() == 0


def test_viterbi_is_the_likeliest_split():
    counts = {"the": 50, "there": 8, "re": 9, "a": 20, "in": 30, "rein": 2}
    total = float(sum(counts.values()))

    def logp(w):
        return math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)

    def best(s):
        return max(([logp(s[:k]) + t[0], [s[:k], *t[1]]] for k in range(1, len(s) + 1) for t in [best(s[k:])]), key=lambda x: x[0]) if s else [0.0, []]

    for s in ("therein", "inthere", "xin", "aaa"):
        known = {(i, n): logp(s[i : i + n]) for i in range(len(s)) for n in range(1, len(s) - i + 1) if s[i : i + n] in counts}
        assert abs(sum(map(logp, urls.viterbi(s, known, total))) - best(s)[0]) < 1e-9


def test_long_labels_and_long_words(spark):
    import math

    r = random.Random(3)
    words = {"the": 9, "pneumonoultramicroscopicsilicovolcano": 4, "x" * 25: 3, "ab": 5, "a": 2, "b": 2}
    total = float(sum(words.values()))
    labels = ["the" * 40 + "ab", "ab" + "pneumonoultramicroscopicsilicovolcano" * 3 + "the", "x" * 60, "q" * 70, "a"] + ["".join(r.choice(list(words)) for _ in range(30)) for _ in range(5)]

    def best(x):
        cost = lambda w: math.log(words[w] / total) if w in words else math.log(10 / total) - len(w) * math.log(10)
        p = [0.0]
        for end in range(1, len(x) + 1):
            p.append(max(p[s] + cost(x[s:end]) for s in range(end)))
        return p[-1], cost

    rows = urls.segmented(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(list(words.items()), "word string, count long"), total).collect()
    assert sorted(x.label for x in rows) == sorted(labels)
    for x in rows:
        p, cost = best(x.label)
        assert "".join(x.words) == x.label and abs(sum(map(cost, x.words)) - p) < 1e-9


def test_hot_keys_and_null_keys_join_like_others(spark):
    from curata.llm import common

    left = spark.createDataFrame([("hot", k) for k in range(3000)] + [(f"k{k}", k) for k in range(40)] + [(None, 1), ("none", 2)], "key string, n int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{k}", k) for k in range(30)], "key string, v int")
    for how in ("inner", "left"):
        assert sorted(map(str, common.hot_join(left, right, "key", how).collect())) == sorted(map(str, left.join(right, "key", how).collect()))
