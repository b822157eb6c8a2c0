import datetime as dt
import random

from lockstep.llm import url_filter

DAY = dt.date(2020, 1, 1)


def expected(captures, entries):
    rank = {"block": 0, "allow": 1, "off": 2}
    out = []
    for n, host, day in captures:
        best = None
        labels = host.split(".") if host else []
        for k in range(len(labels)):
            domain = ".".join(labels[k:])
            past = [(d, -rank[a], a) for e, d, a in entries if e == domain and day is not None and d <= day]
            if past and max(past)[2] != "off":
                best = best or (domain, max(past)[2])
        out.append((n, *(best or (None, None)), (best or ("", "allow"))[1] != "block"))
    return sorted(out)


def test_every_capture_against_the_entries_of_its_day(spark):
    rng = random.Random(6)
    domains = ["com", "a.com", "b.a.com", "c.b.a.com", "x.org"]
    entries = [(rng.choice(domains[1:]), DAY + dt.timedelta(rng.randint(0, 9000)), rng.choice(["block", "allow", "off"])) for _ in range(120)]
    captures = [(n, rng.choice([*domains, "www.c.b.a.com", "y.x.org", "q.net"]), DAY + dt.timedelta(rng.randint(-50, 9100))) for n in range(1500)]
    rows = spark.createDataFrame([(n, f"http://User@{h.upper()}.:8080/p?q", dt.datetime.combine(d, dt.time(23, 59))) for n, h, d in captures],
                                 "n long, url string, fetched_at timestamp")
    listed = spark.createDataFrame(entries, "domain string, listed_on date, action string")
    got = url_filter.filter_urls(rows, listed).select("n", "matched_domain", "matched_action", "allowed").collect()
    assert sorted(map(tuple, got)) == expected(captures, entries)


def test_intervals_are_tiled_exactly(spark):
    spans = [(0, 1), (5, 40_000), (15, 17), (4096, 8192), (1, 65_536), (300, 300 + 4096), (16, 32), (255, 257)]
    rows = spark.createDataFrame([(f"d{k}", "block", a, b) for k, (a, b) in enumerate(spans)], "domain string, action string, from_day int, to_day int")
    for k, (a, b) in enumerate(spans):
        blocks = url_filter.interval_blocks(rows.where(f"domain = 'd{k}'")).collect()
        days = [d for r in blocks for d in range(r["block"] * url_filter.LEVELS[r["level"]], (r["block"] + 1) * url_filter.LEVELS[r["level"]])]
        assert sorted(days) == list(range(a, b)) and len(blocks) <= 30 * len(url_filter.LEVELS)


def test_odd_rows(spark):
    kind = "n long, url string, fetched_at timestamp, host string, domain string, best string"
    noon = dt.datetime(2020, 5, 1, 12)
    rows = [(1, None, noon, "h", "d", "b"), (2, "relative/path", noon, "h", "d", "b"), (3, "http://a.com/", None, "h", "d", "b"),
            (4, "http://a.com/" + "x" * 100_000, noon, None, "d", "b"), (4, "http://a.com/", noon, "h", "d", "b"), (None, "", noon, "h", "d", "b")]
    captures = spark.createDataFrame(rows, kind)
    listed = spark.createDataFrame([("A.com", DAY, "block"), ("a.com", DAY, "allow"), (None, DAY, "block"), ("a.com", None, "off")],
                                   "domain string, listed_on date, action string")
    out = url_filter.filter_urls(captures, listed)
    assert sorted((str(r["n"]), r["allowed"], r["domain"]) for r in out.collect()) == [
        ("1", True, "d"), ("2", True, "d"), ("3", True, "d"), ("4", False, "d"), ("4", False, "d"), ("None", True, "d")]
    assert url_filter.filter_urls(captures.limit(0), listed).collect() == []
    assert all(r["allowed"] for r in url_filter.filter_urls(captures, listed.limit(0)).collect())
