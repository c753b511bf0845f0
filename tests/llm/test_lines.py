import pytest

from folio.llm import lines

SCHEMA = "page_id long, url string, html string, host string, common int"
PAGES = [
    *[(k, f"https://Site.example:80/p{k}", f"<html><title>page {k}</title><nav>Menu</nav><p>own {k}<br/> Shared on half\n</p>{'<p>half</p>' if k % 2 else ''}<script>Menu</script>", "x", 1) for k in range(6)],
    (10, "https://two.example", "<p>Menu</p><p>a</p>", "x", 1),
    (11, "https://two.example", "<p>Menu</p><b>b</b>", "x", 1),
    (12, None, None, "x", 1),
    (13, "no host", "<p></p> ", "x", 1),
    (13, "no host", "<p></p> ", "x", 1),
    (14, "https://all.example/", "only", "x", 1),
    (15, "https://all.example/", "only\nonly", "x", 1),
    (16, "https://all.example/", "only<!-- x\n -->", "x", 1),
    (None, "https://long.example/", "word " * 60000, "x", 1),
]


def want():
    out = {(k, "site.example:80", 4 + k % 2, 2, f"page {k}\nown {k}" + ("\nhalf" if k % 2 else "")) for k in range(6)}
    out |= {(10, "two.example", 2, 1, "a"), (11, "two.example", 2, 1, "b"), (12, "", 0, 0, ""), (13, "", 0, 0, "")}
    out |= {(14, "all.example", 1, 1, ""), (15, "all.example", 2, 2, ""), (16, "all.example", 1, 1, "")}
    return out | {(None, "long.example", 1, 0, ("word " * 60000).strip())}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_boilerplate(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
    got = [tuple(r) for r in lines.drop_boilerplate(spark.createDataFrame(PAGES, SCHEMA)).collect()]
    assert len(got) == len(PAGES) and set(got) == want()


def test_hubs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines.common, "hub_bound", lambda rows: 1)
    got = [tuple(r) for r in lines.drop_boilerplate(spark.createDataFrame(PAGES, SCHEMA)).collect()]
    assert len(got) == len(PAGES) and set(got) == want()


def test_empty_table(spark):
    assert lines.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
