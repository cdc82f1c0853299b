"""Queries over whole tables that SQL can't tell, against plain versions."""

from __future__ import annotations

import re

from glyphweave import fixtures, plans

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return plans.queries()[name](spark, SF).collect()


def turns(spark):
    return [r for r in fixtures.table(spark, SF, "conversations").collect() if r.text is not None]


def escaped(text):
    text = re.sub(r"([`*~\[\]<>])", r"\\\1", text.replace("\\", "\\\\"))
    return re.sub(r"(?<!\w)_|_(?!\w)", r"\\_", text)


def test_md_escape_whole(spark):
    want = sorted((r.conv_id, r.turn, escaped(r.text), max([3, *[len(x) + 1 for x in re.findall("`+", r.text)]])) for r in turns(spark))
    assert sorted((r.conv_id, r.turn, r.text, r.fence) for r in rows_of(spark, "md_escape_whole")) == want


def test_list_records_whole(spark):
    want = []
    for r in turns(spark):
        for i, text in enumerate(r.text.split("\n")):
            line = ["- ", f"  {r.turn}. ", "    - [x] ", "b. [ ] ", ""][(r.conv_id + r.turn) % 5] + text
            m = re.match(r"^( *)(-|[0-9]+\.|[A-Za-z]+\.)(?:\s+\[([ xX])\])?\s+(.*)$", line, re.ASCII)
            want.append((r.conv_id, r.turn, i, "item" if m else "continuation", (m[4] if m else line).strip(" "), m[2].rstrip(".") if m else None))
    got = [(r.conv_id, r.turn, r.i, r.kind, r.content, r.marker) for r in rows_of(spark, "list_records_whole")]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({g[:2] for g in got}) == len({(r.conv_id, r.turn) for r in turns(spark)})


def test_quote_records_whole(spark):
    want = []
    for r in turns(spark):
        for i, text in enumerate(r.text.split("\n")):
            line = "> " * ((r.conv_id + r.turn) % 4) + ("```" if r.turn % 3 == 0 else text)
            lead = re.match(r"(?:> ?)*", line)[0]
            want.append((r.conv_id, r.turn, i, lead.count(">"), bool(re.match("`{3,}|~{3,}", line[len(lead) :].strip(" ")))))
    assert sorted((r.conv_id, r.turn, r.i, r.depth, r.fence) for r in rows_of(spark, "quote_records_whole")) == sorted(want)


def test_render_markdown_whole(spark):
    docs = {}
    for r in fixtures.doc_lines(spark, SF).collect():
        docs.setdefault(r.doc_id, []).append((r.page * 40 + r.seq, ("## " if r.bold else "- " if r.mono else "") + escaped(r.text)))
    assert {r.doc_id: r.markdown for r in rows_of(spark, "render_markdown_whole")} == {k: "\n\n".join(x for _, x in sorted(v)) for k, v in docs.items()}


def test_levenshtein_turns(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1] / max(len(a), len(b)) if a or b else 0.0

    by_conversation = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by_conversation.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    want = []
    for conv, turns_of in by_conversation.items():
        for k, (turn, role, text) in enumerate(sorted(turns_of)):
            want.append((conv, turn, role, round(plain(sorted(turns_of)[k - 1][2] if k else "", text), 9)))
    assert sorted((r.conv_id, r.turn, r.role, round(r.ratio, 9)) for r in rows_of(spark, "levenshtein_turns")) == sorted(want)


def test_position_clusters(spark):
    """Counted anew: running means by sums, groups by the box so far."""
    pages = {}
    for r in fixtures.doc_lines(spark, SF).collect():
        pages.setdefault((r.doc_id, r.page), []).append(r)
    want = []
    for key, rows in pages.items():
        rows.sort(key=lambda r: r.seq)
        sums, groups, box, last = [], 0, None, None
        for r in rows:
            at = [k for k, (s, n) in enumerate(sums) if abs(s / n - r.x0) <= 20]
            if at:
                sums[at[0]] = (sums[at[0]][0] + r.x0, sums[at[0]][1] + 1)
            else:
                sums.append((r.x0, 1))
            far = box is not None and (max(0, box[0] - r.x1, r.x0 - box[2]) ** 2 + max(0, box[1] - r.y1, r.y0 - box[3]) ** 2) ** 0.5 > 14
            if box is None or r.seq != last + 1 or far:
                groups, box = groups + 1, (r.x0, r.y0, r.x1, r.y1)
            else:
                box = (min(box[0], r.x0), min(box[1], r.y0), max(box[2], r.x1), max(box[3], r.y1))
            last = r.seq
        want.append((*key, len(sums), max(n for _, n in sums), groups))
    assert sorted((r.doc_id, r.page, r.clusters, r.largest, r.groups) for r in rows_of(spark, "position_clusters")) == sorted(want)


def test_character_accuracy(spark):
    """Matching blocks by their definition: the longest common piece, first in one and then in the other, and so on at both sides of it."""

    def same(a, b):
        best = (0, 0, 0)
        ends = {}
        for i, x in enumerate(a):
            new = {}
            for j in [j for j, y in enumerate(b) if y == x]:
                n = new[j] = ends.get(j - 1, 0) + 1
                if n > best[0]:
                    best = (n, i - n + 1, j - n + 1)
            ends = new
        n, i, j = best
        return n + same(a[:i], b[:j]) + same(a[i + n :], b[j + n :]) if n else 0

    by_conversation = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by_conversation.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = []
    for conv, turns_of in sorted(by_conversation.items())[:12]:
        turns_of.sort(key=lambda t: (t[0], t[1] is not None, t[1] or ""))
        want += [(conv, b[0], same(a[1], b[1]) / max(len(a[1]), len(b[1]))) for a, b in zip(turns_of, turns_of[1:], strict=False) if a[1] and b[1]]
    got = {(r.conv_id, r.turn): r.accuracy for r in rows_of(spark, "character_accuracy")}
    assert want and all(abs(got[conv, turn] - ratio) < 1e-12 for conv, turn, ratio in want)
