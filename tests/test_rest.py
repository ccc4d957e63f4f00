import json

import pytest

from docuplane.sources import rest as R


def service(answers):
    calls = []

    def transport(path, params):
        calls.append((path, params))
        a = answers.pop(0) if isinstance(answers, list) else answers(path, params)
        if isinstance(a, Exception):
            raise a
        return a

    return transport, calls


def client(answers, **kw):
    slept = []
    t, calls = service(answers)
    return R.RestClient(t, kw.pop("budget", R.CallBudget(100, blind=100)), sleep=slept.append, **kw), calls, slept


def test_tries_again_and_gives_up():
    ok = (200, {}, {"a": 1})
    c, calls, slept = client([(429, {"Retry-After": "7"}, None), (503, {}, None), OSError("down"), ok])
    assert c.get("/x") == {"a": 1} and len(calls) == 4 and slept[0] == 7.0 and c.log[-1] == ("/x", 200)
    c, calls, _ = client([(402, {}, None)])
    with pytest.raises(R.RequestFailed):
        c.get("/x")
    assert len(calls) == 1
    c, calls, _ = client(lambda p, q: (500, {}, None), tries=3)
    with pytest.raises(R.RequestFailed):
        c.get("/x")
    assert len(calls) == 3


def test_budget():
    c, _, _ = client(lambda p, q: (200, {"X-RateLimit-Remaining": "3"}, {}), budget=R.CallBudget(10, reserve=2, blind=1))
    c.get("/x")
    c.get("/x")
    c.budget.remaining = 2
    assert c.budget.stop_reason() == "reserve"
    with pytest.raises(R.BudgetSpent):
        c.get("/x")
    assert R.CallBudget(5, blind=0).stop_reason() == "blind" and R.CallBudget(0).stop_reason() == "ceiling"


def test_bucket_waits():
    now = [0.0]

    def sleep(s):
        now[0] += s

    b = R.TokenBucket(2.0, 1, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        b.acquire()
    assert abs(now[0] - 2.0) < 1e-6


def test_pages_and_days(spark):
    c, calls, _ = client([(200, {}, {"data": [{"i": 1}], "pagination": {"has_next": True}}), (200, {}, {"data": [{"i": 2}], "pagination": {"has_next": False}})])
    assert [r["i"] for p in c.pages("/s") for r in p] == [1, 2] and calls[1][1]["page"] == 2

    def make():
        def transport(path, params):
            return 200, {}, {"data": [{"day": params["day"], "n": k} for k in range(2)], "pagination": {"has_next": False}}

        return R.RestClient(transport, R.CallBudget(10))

    days = R.days_between("2020-02-28", "2020-03-01")
    got = R.search_days(spark, days, make).collect()
    assert sorted((x["day"], json.loads(x["record"])["n"]) for x in got) == [(d, k) for d in days for k in range(2)]
    stored = spark.createDataFrame([("2020-02-28",)], "day string")
    assert sorted(x["day"] for x in R.missing_days(days, stored).collect()) == ["2020-02-29", "2020-03-01"]


def test_windows_and_names():
    rows = [{"d": f"2020-01-{k:02d}"} for k in range(1, 29)] * 2

    def count(a, b):
        return [r for r in rows if a <= r["d"] <= b][:10]

    assert len(R.capped_windows("2020-01-01", "2020-01-28", count, cap=10)) == 28
    assert R.request_key("e", {"a": 1, "b": 2}) == R.request_key("e", {"b": 2, "a": 1})
    assert R.stored_name(b"", 5)[1] == "empty" and R.stored_name(b"abcdef", 5)[1] == "too_large" and R.stored_name(b"PK\x03\x04", 50)[1] == "bad_zip" and R.stored_name(b"\x00\x01", 50)[1] == "not_a_kept_type"
    assert R.stored_name(b"plain", 50)[0].endswith(".txt")
