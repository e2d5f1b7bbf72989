"""How texts travel in near-duplicate detection."""

from __future__ import annotations

import contextlib
import io

from fleetglass.llm import overlaps


def test_texts_meet_roles_by_a_sorted_join(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string")
    members = spark.createDataFrame([(7, k, 6) for k in range(6)], "list long, doc_id long, n long")
    links = overlaps.hub_links(members, docs, 5, 75)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        links.explain()
    above, _, below = out.getvalue().partition("SortMergeJoin")
    assert below and "BroadcastHashJoin" not in above
    assert {tuple(r) for r in links.collect()} == {(0, k) for k in range(1, 6)}
