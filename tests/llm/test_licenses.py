"""License notices that are wrapped, stand close together or lie inside other text."""

import textwrap

from quarry.llm import licenses


def found(text):
    scanner = licenses.Scanner()
    return sorted((line + n["line"], n["license"], " ".join(n["missing"]), " ".join(n["added"])) for line, block in licenses.blocks(text) for n in scanner.scan(block))


def test_wrapped_notices():
    around = "\n".join(f"Some words of the program, and it is {k} of them to be read." for k in range(30))
    for license_id, wordings in licenses.NOTICES.items():
        for wording in wordings:
            for width in (24, 40, 70):
                for mark in ("", "# "):
                    wrapped = "\n".join(mark + x for x in textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=False))
                    assert found(wrapped) == [(0, license_id, "", "")], (wrapped, width)
                    assert found(f"{around}\n\n{wrapped}\n\n{around}") == [(31, license_id, "", "")], (wrapped, width)


def test_many_notices_in_one_block():
    notices = [(k, w) for k, wordings in licenses.NOTICES.items() for w in wordings]
    assert [x[:2] for x in found("\n".join(w for _, w in notices))] == [(n, k) for n, (k, _) in enumerate(notices)]
    assert [x[:2] for x in found(" ".join(w for _, w in notices))] == sorted((0, k) for k, _ in notices)


def test_a_notice_that_is_repeated():
    wording = licenses.NOTICES["MIT"][0]
    assert [x[:2] for x in found(f"{wording}\nother\n{wording}\n")] == [(0, "MIT"), (2, "MIT")]
