import pytest

from rankloom.llm import variants as V


@pytest.mark.parametrize("most", [0, 1, 200_000])
def test_full_memo_changes_no_reading(monkeypatch, most):
    monkeypatch.setattr(V, "MEMO", most)
    n = V.GivenNames([("pattie", "patricia"), ("mattie", "martha")])
    for name in ("Xattie Smith", "Smith, Xattie", "Xattie Smith"):
        assert V.read_name(name, n) == [("martha", "smith"), ("patricia", "smith")]
    assert n.nearest("xattie") == (None, ["martha", "patricia"]) and n.find("xattie") is None
    assert len(n.known) <= most
