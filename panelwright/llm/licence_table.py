"""Table of common licences: entire texts with their wording variants, and notices of one line.

Long texts are files of ``licence_texts``; short ones stand here.  Titles, copyright lines, owners' names and
addresses are not listed as variants: ``licences.core`` takes them off both sides.
"""

from __future__ import annotations

import re
from pathlib import Path

FOLDER = Path(__file__).with_name("licence_texts")
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: Texts are also spread without what follows their terms: from this line on, or after it.
ENDS = [r"\n[^\n\w]*END OF TERMS AND CONDITIONS[^\n]*", r"\n[^\n\w]*Exhibit A - Source Code", r"\n[^\n\w]*EXHIBIT A ?-", r"\n[^\n\w]*ADDENDUM: How to use", r"\n[^\n\w]*(Appendix: )?How to Apply These Terms"]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_ISC = "Permission to use, copy, modify, {}distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = '.\nTHE SOFTWARE IS PROVIDED "AS IS" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_ITEMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n",
]
_BSD_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Names a notice gives each licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    **{
        f"{short}-{v}": [f"GNU {long}, version {v.removesuffix('.0')}", f"GNU {long} version {v.removesuffix('.0')}", f"GNU {long} v{v}", f"GNU {long} v{v.removesuffix('.0')}", f"{short}v{v.removesuffix('.0')}", f"{short} {v}"]
        for short, long, versions in [("GPL", "General Public License", ["2.0", "3.0"]), ("LGPL", "Lesser General Public License", ["2.1", "3.0"]), ("AGPL", "Affero General Public License", ["3.0"])]
        for v in versions
    },
    **{f"CC-{kind}-{v}": [f"CC {kind} {v}", f"CC-{kind}-{v}", f"CC-{kind} {v}", f"Creative Commons {long} {v} International License" if v == "4.0" else f"Creative Commons {long} {v} License"]
       for kind, long in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
       for v in ["3.0", "4.0"]},
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License"],
}


def _numbered(items: list[str], marks: list[str]) -> str:
    return "".join(m + x for m, x in zip(marks, items, strict=True))


def _files() -> list[tuple[str, str]]:
    out = []
    for file, name in FILES.items():
        text = (FOLDER / f"{file}.txt").read_text(encoding="utf-8", errors="replace")
        out.append((name, text))
        for end in ENDS:
            if m := re.search(end, text):
                out += [(name, text[: m.start()]), (name, text[: m.end()])]
    return out


def _short() -> list[tuple[str, str]]:
    rule = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    out = [("MIT", f"{_MIT}, subject to the following conditions:\n{r}\n{_AS_IS}") for r in (rule, rule.replace("notice shall", "notice (including the next paragraph) shall"))]
    out += [("MIT-0", f"{_MIT}.\n{_AS_IS}")]
    for either in ("and/or ", "and "):
        for who in ("THE AUTHOR", "THE COPYRIGHT HOLDER", "ISC"):
            end = _ISC_END.format(who, who)
            ends = [end, end.replace("THE AUTHOR BE", "THE AUTHORS BE").replace("AUTHOR DISCLAIMS", "AUTHORS DISCLAIM")]
            out += [(name, _ISC.format(either) + notice + e) for name, notice in (("ISC", _ISC_NOTICE), ("0BSD", "")) for e in ends]
    for marks in (["1. ", "2. ", "3. "], ["", "", ""], ["a. ", "b. ", "c. "]):
        out += [("BSD-2-Clause", _BSD + _numbered(_BSD_ITEMS[:2], marks[:2]) + _BSD_END), ("BSD-3-Clause", _BSD + _numbered(_BSD_ITEMS, marks) + _BSD_END)]
    for marks in (["1. ", "2. ", "3. ", "4. "], ["", "", "", ""]):
        out.append(("BSD-4-Clause", _BSD + _numbered([*_BSD_ITEMS[:2], _BSD_ADVERT, _BSD_ITEMS[2]], marks) + _BSD_END))
    link = "\nFor more information, please refer to <http://unlicense.org/>"
    out += [("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + link), ("Unlicense", _UNLICENSE + link.rstrip("/>") + ">"), ("BSL-1.0", _BOOST)]
    return out


def texts() -> list[tuple[str, str]]:
    """(licence, entire text) of every wording."""
    return _files() + _short()


def notices() -> list[tuple[str, str]]:
    """(licence notice, line): what a text says of its licence in one line; ``licences.NOTICE`` takes other forms to this one."""
    out = []
    for licence, names in NAMES.items():
        spdx = [licence] + [f"{licence}-{x}" for x in ("only", "or-later") if "GPL" in licence]
        out += [(f"{licence} notice", f"Licensed under {name}") for name in dict.fromkeys([*names, *spdx])]
    return out
