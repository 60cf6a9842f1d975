"""Whole licences as they are spread: from the system's own files and in other dress, none of it from the driver tables."""

import re
import textwrap
from pathlib import Path

import pytest

from panelwright.llm import licence_table, licences

SYSTEM = Path("/usr/share/common-licenses")
BSD3 = dict(licence_table.texts())["BSD-3-Clause"]


def found(documents, texts):
    rows = {r.doc_id: r.license for r in licences.scan(documents(list(enumerate(texts)))).collect()}
    return [rows[i] for i in range(len(texts))]


def test_whole_files_of_the_system(documents):
    if not SYSTEM.is_dir():
        pytest.skip("no licence files here")
    names = {f: n for f, n in licence_table.FILES.items() if (SYSTEM / f).exists()}
    raw = {f: (SYSTEM / f).read_text(errors="replace") for f in names}
    cases = []
    for f, name in names.items():
        # a statement of copyright keeps its line
        flat = "\n\n".join(p if "copyright (c)" in p.lower() else textwrap.fill(p, 58) for p in re.split(r"\n\s*\n", raw[f]))
        cases += [(raw[f], name), ("\n".join(" * " + x for x in raw[f].splitlines()), name), (flat.replace("http:", "https:"), name)]
        cases += [("Copyright Jane Doe\n\n" + raw[f], name), (raw[f].replace("copy", "kopy", 1), None)]
    apache = raw["Apache-2.0"]
    cases += [(apache.replace("[yyyy] [name of copyright owner]", "2021 Jane Doe"), "Apache-2.0"), (apache[: apache.index("APPENDIX")], "Apache-2.0")]
    cases += [(raw["GPL-2"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"), "GPL-2.0")]
    got = found(documents, [t for t, _ in cases])
    assert [(i, g, n) for i, (g, (_, n)) in enumerate(zip(got, cases)) if g != n] == []


def test_titles_and_copyright_lines(documents):
    mit = licences.KNOWN["MIT"].split("\n", 2)[2]
    isc = licences.KNOWN["ISC"]
    heads = ["", "MIT License\n\n", "The MIT License (MIT)\n\n", "The MIT License\n", "# MIT License #\n"]
    lines = ["Copyright Jane Doe\n\n", "Copyright [year] [owner]\n", "Copyright © 2020 Jane Doe\n", "Copyright (c) 2020, Jane & Co. All rights reserved.\n", "Portions Copyright 2001 Jane\n", "Copyrights The Jane Authors\n"]
    cases = [(h + x + mit, "MIT") for h in heads for x in lines]
    cases += [(h + x + isc, "ISC") for h in ("ISC License\n", "The ISC License (ISC)\n", "ISC License:\n") for x in lines]
    cases += [(textwrap.fill(mit, w), "MIT") for w in (20, 33, 47, 72)]
    named = BSD3.replace("the copyright holder nor", "Jane Doe nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "Jane Doe").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "Jane Doe")
    cases += [("BSD 3-Clause License\nCopyright Jane\n" + named, "BSD-3-Clause"), (named.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause")]
    cases += [("Copyright Jane Doe", None), ("MIT License", None), ("Copyright Jane\n" + mit + "\nbut not on Sundays", None)]
    got = found(documents, [t for t, _ in cases])
    assert [(i, g, n) for i, (g, (_, n)) in enumerate(zip(got, cases)) if g != n] == []


def test_notices_in_other_words(documents):
    rows = {1: "text\nThis project is licensed under the BSD 3-Clause License.\nmore", 2: "// SPDX-License-Identifier: MPL-2.0\ncode", 3: "Released under the GNU General Public License v2.0", 4: "licensed under nothing"}
    got = {r.doc_id: r.notices for r in licences.scan(documents(list(rows.items()))).collect()}
    assert got == {1: "BSD-3-Clause notice", 2: "MPL-2.0 notice", 3: "GPL-2.0 notice", 4: ""}


def test_every_known_text_has_a_mark_and_one_licence(spark):
    entries = licences.known_entries(spark, [*licences.KNOWN.items(), *licence_table.texts(), *licence_table.notices()])
    assert all(any(m in r.text for m in licences.MARKS) for r in entries)
    names = {}
    for r in entries:
        names.setdefault(r.core_digest, set()).add(r.license)
    assert {k: v for k, v in names.items() if k and len(v) > 1} == {}
