from __future__ import annotations

from panelkite.llm import pii


def test_names_in_footers_and_far_from_the_value_are_marked(spark, table_of):
    far = "word " * 40
    docs = {k: f"Note {k} of May. {far}Quibble. Ask Quibble: qq@mail.org" for k in range(30)}  # one footer
    docs |= {100 + k: f"Zorblatt, item {k}. {far}{far}write to zb@mail.org; {far}zorblatt" for k in range(30)}
    docs |= {200 + k: f"Note {k} of June, item {k}. {far}" for k in range(300)}
    docs |= {600 + k: "Only Once at oo@mail.org" for k in range(30)}  # copies of one text prove nothing
    found = {r.doc_id: r for r in pii.sanitise(table_of(docs)).collect()}
    terms = lambda d: [found[d].text[t.start : t.end] for t in found[d].terms]
    assert all(terms(k).count("Quibble") == 2 for k in range(30)), terms(3)
    assert all({"Zorblatt", "zorblatt"} <= set(terms(100 + k)) for k in range(30)), terms(103)
    assert not any({"word", "Note", "item"} & set(terms(d)) for d in found)
    assert not any(terms(d) for d in (*range(200, 500), *range(600, 630)))
    assert "ibble" not in found[3].clean_text
