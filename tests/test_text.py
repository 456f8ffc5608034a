from lakequill.functions.text import fold, mixed_tokens
from lakequill.operators.extract import byte_pieces, number_keys, paragraph_chunks
from lakequill.operators.graph import louvain_labels


def test_tokens():
    assert mixed_tokens("PagedAttention") == ["pagedattention"]
    assert mixed_tokens("木") == ["木"]
    assert mixed_tokens("３台") == mixed_tokens("3台") and {"3", "台", "3台"} <= set(mixed_tokens("3台"))
    assert "13台" in mixed_tokens("13台のGPU") and "3台" not in mixed_tokens("13台のGPU")
    assert {"kv", "キャ", "管理"} <= set(mixed_tokens("KVキャッシュ管理"))
    assert "h100" in mixed_tokens("H100") and "100" in mixed_tokens("H100")
    assert {"1000", "1000台"} <= set(mixed_tokens("1,000台")) & set(mixed_tokens("1000台"))
    assert mixed_tokens(None) == [] and mixed_tokens("a the") == []


def test_fold():
    assert fold("Ｇｒａｐｈ Ｎｅｔ") == "graphnet" and fold("Straße") == "strasse" and fold(None) == ""


def test_pieces():
    text = "ä" * 3000 + "\n\n" + "b c " * 900
    assert "".join(byte_pieces(text)) == text and all(len(p.encode()) <= 1800 for p in byte_pieces(text)) and byte_pieces(None) == []
    assert paragraph_chunks("") == [] and len(paragraph_chunks("\n\n".join(["x" * 900] * 5))) == 3
    assert number_keys("1,000,000 and 1M") == ["1000000"]


def test_louvain_ring_of_pairs():
    import numpy as np

    a, b = np.array([0, 1, 2, 3, 4, 5]), np.array([1, 0, 3, 2, 5, 4])
    labels = louvain_labels(a, b, np.ones(6), 6)
    assert labels[0] == labels[1] != labels[2] == labels[3] != labels[4] == labels[5]
