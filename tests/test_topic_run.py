"""A topic's run from found URLs to staged records, with a web of its own."""

import os
import uuid

from siltstone.operators import topic

WORDS = "some words about broadcast joins and how they are planned in clusters of many machines "
WEB = {
    "https://a.org/1": (200, "html", f"<html><title>One</title><body><p>{WORDS * 3}</p></body></html>", {"ETag": "e1"}),
    "https://a.org/2": (200, "html", f"<html><body><p>{WORDS * 3}</p></body></html>", {}),  # the same text
    "https://a.org/3": (404, "html", "gone", {}),
    "https://a.org/private/x": (200, "html", f"<p>{WORDS * 5}</p>", {}),
    "https://b.org/4": (200, "html", "<p>too short</p>", {"Last-Modified": "m4"}),
    "https://b.org/5": (200, "image", "...", {}),
    "https://b.org/6": (200, "html", f"<p>{WORDS * 9}</p>", {}),
}


def fetcher(folder):
    def fetch(url, headers):
        open(os.path.join(folder, uuid.uuid4().hex), "w").write(url)
        if url not in WEB:
            raise OSError("no such host")
        if headers.get("If-None-Match") and headers["If-None-Match"] == WEB[url][3].get("ETag"):
            return 304, None, None, {}
        return WEB[url]

    return fetch


def asked(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


def test_run(spark, tmp_path):
    calls = [tmp_path / "first", tmp_path / "second"]
    for c in calls:
        c.mkdir()
    urls = ["https://a.org/1", "https://A.org/1?utm_source=x", "https://a.org/2", "https://a.org/3", "https://a.org/private/x", "https://b.org/4", "https://b.org/5", "https://c.org/7", "https://b.org/6"]
    found = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    of = topic.settled({"id": "t", "title": "T", "filters": {"min_words": 20}, "budget": {"max_new_urls": 10, "max_total_bytes": 1_000_000}})
    staged = spark.createDataFrame([], "canonical_url string, body_hash string")
    cache = spark.createDataFrame([], topic.CACHE)
    robots = lambda host: "User-agent: *\nDisallow: /private" if host == "a.org" else None
    out = topic.run(found, topic.by_calls(fetcher(str(calls[0])), robots), of, staged, cache, "2026-01-01")
    got = {r["page_id"]: r["outcome"] for r in out["pages"].collect()}
    assert got == {0: "accepted", 2: "seen", 3: "status:404", 4: "robots", 5: "too_short", 6: "content_type:image", 7: "error", 8: "accepted"}
    assert asked(str(calls[0])) == sorted(u for u in [*WEB, "https://c.org/7"] if "private" not in u)  # a URL once, what is forbidden never
    records = out["records"].collect()
    assert {r["title"] for r in records} == {"One", ""} and all(r["body_md"].startswith("some words") for r in records)
    assert {(r["canonical_url"], r["etag"], r["last_modified"]) for r in out["cache"].collect()} == {("https://a.org/1", "e1", None), ("https://b.org/4", None, "m4")}
    kinds = sorted(r["kind"] for r in out["events"].collect())
    assert (kinds.count("fetched"), kinds.count("accepted"), kinds.count("seen")) == (6, 2, 1)
    (row,) = topic.listed([of], out["events"]).collect()
    assert (row["topic"], row["fetched"], row["accepted"]) == ("t", 6, 2)
    # again: what was accepted is known; a page of which there is a copy comes from it
    held = out["records"].filter("page_id = 8").select("canonical_url", "body_hash")
    again = topic.run(found, topic.by_calls(fetcher(str(calls[1])), robots), of, held, out["cache"], "2026-01-02")
    second = {r["page_id"]: r["outcome"] for r in again["pages"].collect()}
    assert second[8] == "known" and second[0] == "accepted" and second[2] == "seen"
    assert "https://b.org/6" not in asked(str(calls[1]))


def test_a_run_stops_at_its_budget(spark, tmp_path):
    found = spark.createDataFrame([(k, f"https://d.org/{k}") for k in range(30)], "page_id long, url string")
    of = topic.settled({"id": "t", "title": "T", "filters": {"min_words": 1}, "budget": {"max_new_urls": 5, "max_total_bytes": 250}})
    folder = str(tmp_path)
    body = lambda url, headers: (open(os.path.join(folder, uuid.uuid4().hex), "w").write(url), (200, "html", f"<p>{url.rsplit('/', 1)[-1]} {'word ' * 16}</p>", {}))[1]
    out = topic.run(found, topic.by_calls(body), of, spark.createDataFrame([], "canonical_url string, body_hash string"), spark.createDataFrame([], topic.CACHE), "n")
    outcomes = [r["outcome"] for r in out["pages"].orderBy("page_id").collect()]
    assert outcomes == ["accepted", "accepted", "halted", "halted", "halted"] and len(asked(folder)) == 5
