"""Trees and records that older readers took wrongly."""

import pytest

from clademill.sources import text, trees


@pytest.mark.parametrize("newick", ["(a b,c,d);", "(a:,b,c);", "(a:x,b,c);", "(a:1 b,c,d);", "((a,b)x y,c,d);"])
def test_malformed_trees(newick):
    with pytest.raises(trees.TreeError):
        trees.parse(newick)


def test_a_deep_tree_is_written():
    newick = "(" * 3000 + "t0,t1)" + "".join(f",t{k + 2}):0.5" for k in range(2998)) + ",u,v);"
    assert len(list(trees.tips(trees.parse(trees.write(trees.parse(newick)))))) == len(list(trees.tips(trees.parse(newick)))) == 3002
    assert trees.write(trees.parse("(a:1,(b,'c d')x,e);"), 1) == "(a:1.0,(b,'c d')x,e);"


def test_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 a>b\nAC\nGT\n>s2\r\nac-t\r\n")
    got = {r["name"]: r["seq"] for r in text.fasta(spark, str(tmp_path)).collect()}
    assert got == {"s1 a>b": "ACGT", "s2": "AC-T"}
