import itertools
import math
import random
import re

from skiplane.llm import urls
from skiplane.llm.queries import URL_RULES


def brute(url):
    m = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[2]), m[3]) if m else ("", "")
    best = None
    for text, verdict in URL_RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = text, verdict
    return host, path, *(best or (None, None))


def test_parts_and_rules(spark):
    rng = random.Random(1)
    made = ["".join(p) for p in itertools.product(["http://", "https://x://", "", "HTTP://"], ["a.example.", "example.", "EXAMPLE.", "", "anexample."], ["com", "net", "org", "com:80"], rng.sample(["/en/7", "/en/", "/en/75?x#y", "/de/8/a", "/de/", "/es/", "#/en/", "?q=://z", "", "/EN/7", "/fr/é"], 9))]
    rows = [(i, u, None) for i, u in enumerate([*made, None, "", "x" * 100000, "http://" + "ab" * 50000 + "/en/"])]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS verdict"), URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(rows[r["page_id"]][1])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) in ("allow", "block")


def test_splits_like_all_ways():
    split = urls.Splitter({"the": 50, "there": 9, "re": 12, "in": 20, "therein": 1, "n": 2})
    for letters in ("thethere", "therein", "xin", "intherez", "a"):
        ways = [[letters[i:j] for i, j in itertools.pairwise((0, *cut, len(letters)))] for k in range(len(letters)) for cut in itertools.combinations(range(1, len(letters)), k)]
        best = max(sum(map(split.cost, w)) for w in ways)
        assert math.isclose(sum(map(split.cost, split(letters))), best)


BAD, GOOD = "<p>cheap pills at luckyspin and news</p><script>zzz</script>", "<p>garden farming news and luckyspin, the farmhouse</p><!-- pills -->"


def world():
    rows = [(i, f"https://luckyspin{i}.example.org/fr/offer/{i}", BAD) for i in range(40)]
    rows += [(100 + i, f"https://garden-farm{i}.example.org/fr/item/{i}", GOOD) for i in range(60)]
    rows += [(900, "https://spin-lucky.example.org/fr/offer", None), (901, None, None), (902, "https://cheap-garden.example.org/fr/item", GOOD), (903, "https://onlyhere.example.org/fr/", BAD)]
    return rows


def test_evidence_is_the_text_and_reaches_hosts_without_seeds(spark):
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(world(), "page_id bigint, url string, html string"), URL_RULES).collect()}
    assert all(got[i]["verdict"] == "block" and "h:lucky" in got[i]["tokens"] or got[i]["tokens"][0] == "h:luckyspin" for i in range(40))
    assert all(got[100 + i]["verdict"] == "allow" for i in range(60))  # farm is a seed word, but their texts hold none
    assert got[902]["verdict"] == "allow" and got[901]["verdict"] == "allow" and got[901]["host"] == ""
    assert got[903]["block_odds"] < 0.1 < got[0]["block_odds"]  # its own text is left out
    blocked = [i for i, r in got.items() if r["verdict"] == "block"]
    assert any(not {t[2:] for t in got[i]["tokens"]} & set(urls.SEEDS) for i in blocked)
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string"), URL_RULES).count() == 0


def test_odds_by_hand(spark):
    rows = world()
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), URL_RULES).collect()
    side = {i: int(any(w in urls.SEEDS for w in re.findall(r"[a-z]+", re.sub(r"<script>.*?</script>|<[^>]*>", " ", html or "")))) for i, _, html in rows}
    of = {r["page_id"]: r["tokens"] for r in got}
    assert len({urls.feature(t) for ts in of.values() for t in ts}) == len({t for ts in of.values() for t in ts})
    for r in got:
        others = [i for i in of if i != r["page_id"]]
        bags = [[t for i in others if side[i] == k for t in of[i]] for k in range(2)]
        kinds = len({t for ts in of.values() for t in ts})
        want = math.log((sum(side[i] == 1 for i in others) + 1) / (sum(side[i] == 0 for i in others) + 1))
        for t in r["tokens"]:
            if t in bags[0] or t in bags[1]:
                want += math.log((bags[1].count(t) + 1) / (len(bags[1]) + kinds + 1)) - math.log((bags[0].count(t) + 1) / (len(bags[0]) + kinds + 1))
        assert math.isclose(r["block_odds"], want, abs_tol=1e-9)
        assert r["verdict"] == (brute(rows[[x[0] for x in rows].index(r["page_id"])][1])[3] or ("block" if want > 0 else "allow"))
