import pytest

from millrace.operators import mixture as M


def test_largest_remainder():
    w = {"code": 0.45, "common_crawl": 0.35, "wikipedia": 0.20}
    assert M.quotas(w, dict.fromkeys(w, 10), 10) == {"code": 5, "common_crawl": 3, "wikipedia": 2}


@pytest.mark.parametrize("total", [97, 99, 101, 103, 137])
def test_all_goes_to_the_only_domain(total):
    q = M.quotas(M.resolve_weights("balanced"), {"common_crawl": 100}, total)
    assert q["common_crawl"] == total == sum(q.values())


def test_nothing_available():
    assert sum(M.quotas({"a": 1.0}, {}, 5).values()) == 0


@pytest.mark.parametrize("name", list(M.PRESETS))
def test_presets(name):
    w = M.resolve_weights(name)
    assert abs(sum(w.values()) - 1) < 1e-9 and set(w) == set(M.DOMAINS)


def test_bad_weights():
    for w in ("unknown", {"a": -1.0, "b": 2.0}, {"a": 0.0}):
        with pytest.raises(ValueError):
            M.resolve_weights(w)
    with pytest.raises(ValueError):
        M.source_probabilities([{"name": "x", "weight": -1}])


def test_reweighting_goldens():
    default = {d: 1 / 7 for d in M.DOMAINS}
    ref = {"common_crawl": 2.3, "wikipedia": 2.1, "code": 2.1, "academic": 2.7, "books": 2.7, "news": 2.4, "social": 2.3}
    up = M.reweight(default, ref | {"code": ref["code"] + 2.0}, ref)
    assert up["code"] == max(up.values()) and abs(sum(up.values()) - 1) < 1e-9
    once = M.reweight(M.reweight(default, {"code": 3.0}, None), {"code": 3.0}, None)
    both = M.reweight(default, {"code": 3.0}, None, rounds=2)
    assert all(abs(once[d] - both[d]) < 1e-12 for d in once)


@pytest.mark.parametrize("quota", [0, 1, 7, 20, 21, 45])
def test_sample_takes_the_quota(spark, quota):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(30)], "id long, domain string")
    q = M.quota_table(spark, {"a": quota, "b": 3}, {"a": 20, "b": 10})
    rows = M.sample(df, q, "id", buckets=8).collect()
    assert sum(r["copies"] for r in rows if r["domain"] == "a") == quota
    assert sum(r["copies"] for r in rows if r["domain"] == "b") == 3
    assert max([r["copies"] for r in rows if r["domain"] == "a"], default=0) <= quota // 20 + 1


def test_sample_is_a_seeded_choice(spark):
    df = spark.createDataFrame([(i, "a") for i in range(50)], "id long, domain string")
    pick = lambda seed: {r["id"] for r in M.mix(df, {"a": 1.0}, 10, "id", seed=seed).collect()}
    assert pick(1) == pick(1) != pick(2)


def test_only_doremi_reweights(spark):
    df = spark.createDataFrame([(1, "code")], "id long, domain string")
    with pytest.raises(ValueError):
        M.doremi(df, {}, None, 1, "id", composition="balanced")


def test_losses_file(tmp_path):
    p = tmp_path / "l.json"
    p.write_text('{"domain_losses": {"code": 2}}')
    assert M.load_losses(str(p))["domain_losses"] == {"code": 2.0}
    with pytest.raises(FileNotFoundError):
        M.load_losses(str(tmp_path / "none.json"))
