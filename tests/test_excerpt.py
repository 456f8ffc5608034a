"""Budgets against a loop that drops one bullet after the other."""

import random

from lakequill.operators import excerpt as E


def _first(block):
    out, begun = block[:1], False
    for line in block[1:]:
        if begun and not line.strip():
            break
        begun = begun or bool(line.strip())
        out.append(line)
    return out


def _tail(block, n):
    items, i = [], 0
    while i < len(block):
        j = i + 1
        if block[i].startswith(("- ", "* ")):
            while j < len(block) and block[j].strip() and block[j][0] in " \t":
                j += 1
            items.append(range(i, j))
        i = j
    gone = {x for r in items[: max(0, len(items) - n)] for x in r}
    return [x for i, x in enumerate(block) if i not in gone], len(items)


def _shrink(sections, budget):
    text = lambda bs: "\n".join(x for b in bs for x in b) + "\n"
    over = lambda t: max(1, len(t) // 3) > budget
    blocks = [b for _, b in sections]
    if not over(text(blocks)):
        return None, text(blocks)
    blocks = [_first(b) if k == "definition" else b for k, b in sections]
    n = max([_tail(b, 0)[1] for k, b in sections if k == "tail"], default=0)
    now = blocks
    while over(text(now)) and n > 0:
        n -= 1
        now = [_tail(b, n)[0] if k == "tail" else b for (k, _), b in zip(sections, blocks, strict=True)]
    out = text(now)
    return n, out[: max(200, 3 * budget)].rstrip() + "\n" if over(out) else out


def test_shrink(spark):
    rng = random.Random(12)
    docs, rows = {}, []
    for doc in range(60):
        sections = []
        for s in range(rng.randint(1, 5)):
            kind = rng.choice(["definition", "tail", "tail", "prose"])
            block = [f"## s{s}"] + [rng.choice(["- ", "* ", "  ", "", "\t- "]) + "x" * rng.randint(0, 60) for _ in range(rng.randint(0, 9))]
            sections.append((kind, [b.rstrip() for b in block]))
            rows += [(doc, s, kind, i, line) for i, line in enumerate(block)]
        docs[doc] = sections
    budgets = [10, 60, 100, 250, 5000]
    got = {(r.doc, r.budget): (r.bullets, r.excerpt) for r in E.shrink(spark.createDataFrame(rows, "doc long, section int, kind string, place int, line string"), budgets).collect()}
    assert got == {(d, b): _shrink(s, b) for d, s in docs.items() for b in budgets}
    assert len({n for n, _ in got.values()}) > 4


def test_null_lines_and_empty_tables(spark):
    schema = "doc long, section int, kind string, place int, line string"
    (r,) = E.shrink(spark.createDataFrame([(1, 0, None, 0, None)], schema), [5]).collect()
    assert (r.excerpt, r.truncated) == ("\n", False)
    assert E.shrink(spark.createDataFrame([], schema), [5]).collect() == []


def test_outline_and_last_bullets(spark):
    rows = [
        (1, 0, "definition", 0, "## D"), (1, 0, "definition", 1, "what it is"),
        (1, 1, "tail", 0, "## T"), (1, 1, "tail", 1, "- **Bold  claim** and more"), (1, 1, "tail", 2, "  - nested"), (1, 1, "tail", 3, ""), (1, 1, "tail", 4, "### sub"),
        (1, 1, "tail", 5, "* " + "y" * 100), (1, 1, "tail", 6, "- z"), (1, 1, "tail", 7, ""), (1, 1, "tail", 8, ""),
        (1, 2, "prose", 0, "## P"), (1, 2, "prose", 1, "- not a claim"),
    ]
    df = spark.createDataFrame(rows, "doc long, section int, kind string, place int, line string")
    (full,) = E.outline(df, 1000).collect()
    assert (full.total, full.truncated) == (3, False)
    assert full.outline.split("\n") == ["total: 3", "## D", "## T  (3)", "- Bold claim", "### sub", "- " + "y" * 90 + "…", "- z", "## P  (1)", ""]
    (cut,) = E.outline(df, 45).collect()
    assert cut.truncated and cut.outline.split("\n") == ["total: 3", "## D", "## T  (3)", "- Bold claim", "### sub", "## P  (1)", E.NOTE, ""]
    (bare,) = E.outline(df, 2).collect()
    assert bare.outline == "total: 3\n## D\n## T  (3)\n## P  (1)\n" + E.NOTE + "\n"
    kept = {(r.section, r.place) for r in E.last_bullets(df, 2).collect()}
    assert {p for s, p in kept if s == 1} == {0, 3, 4, 5, 6, 7} and (2, 1) in kept
    assert E.outline(df.where("false"), 5).collect() == []
