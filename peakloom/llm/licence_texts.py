"""Public licence texts: short ones as their bodies read without copyright lines, and long ones from licence_bodies."""

from __future__ import annotations

from importlib import resources

_AS_IS = '''THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.'''
_GRANT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so'''
_BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
_BSD_THIRD = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
_BSD_END = '''
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'''
_ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted'''
_ISC_END = '''

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.'''
_MIT = _GRANT + ''', subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

''' + _AS_IS
_ZLIB = '''This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.'''

KNOWN: dict[str, str] = {
    "MIT": "MIT License\n\n" + _MIT,
    "MIT (body)": _MIT,
    "MIT-0": "MIT No Attribution\n\n" + _GRANT + ".\n\n" + _AS_IS,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-2-Clause (titled)": "BSD 2-Clause License\n\n" + _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_END,
    "BSD-3-Clause (titled)": "BSD 3-Clause License\n\n" + _BSD + _BSD_THIRD + _BSD_END,
    "ISC": "ISC License\n\n" + _ISC + ", provided that the above\ncopyright notice and this permission notice appear in all copies." + _ISC_END,
    "ISC (body)": _ISC + ", provided that the above\ncopyright notice and this permission notice appear in all copies." + _ISC_END,
    "0BSD": "BSD Zero Clause License\n\n" + _ISC + "." + _ISC_END,
    "0BSD (body)": _ISC + "." + _ISC_END,
    "Zlib": "zlib License\n\n" + _ZLIB,
    "Zlib (body)": _ZLIB,
}

#: More titles under which the short texts are handed on.
_TITLED = {
    "MIT": (_MIT, ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)")),
    "BSD-2-Clause (titled)": (_BSD + _BSD_END, ("BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License", "Simplified BSD License")),
    "BSD-3-Clause (titled)": (_BSD + _BSD_THIRD + _BSD_END, ("BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License", "New BSD License")),
    "ISC": (_ISC + ", provided that the above\ncopyright notice and this permission notice appear in all copies." + _ISC_END, ("The ISC License",)),
    "Zlib": (_ZLIB, ("The zlib License",)),
}
#: Notices that stand for a licence: (license_id, file of licence_bodies or None, first words, last words).
_NOTICES = (
    ("Apache-2.0", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the", "limitations under the License."),
    ("GPL-1.0", "GPL-1.0", "This program is free software; you can", "USA"),
    ("GPL-2.0", "GPL-2.0", "This program is free software; you can", "USA"),
    ("GPL-3.0", "GPL-3.0", "This program is free software: you can", "<https://www.gnu.org/licenses/>."),
    ("LGPL-2.0", "LGPL-2.0", "This library is free software; you can", "USA"),
    ("LGPL-2.1", "LGPL-2.1", "This library is free software; you can", "USA"),
    ("MPL-2.0", "MPL-2.0", "This Source Code Form is subject to the terms", "http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", None, "Licensed under the Apache License, Version 2.0.", ""),
    ("CC-BY-NC-4.0", None, "Licensed under CC BY-NC 4.0.", ""),
    ("GPL-3.0", None, "This work is licensed under the GNU General Public License, version 3.", ""),
    ("MIT", None, "Released under the MIT License.", ""),
)
_END = "END OF TERMS AND CONDITIONS"


def bodies() -> dict[str, str]:
    """Texts of the files in licence_bodies by file name; what follows a ``~`` tells editions of one licence apart."""
    folder = resources.files(__package__) / "licence_bodies"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of everything that is looked up: KNOWN, more titles, whole long texts with and without what
    follows their terms, and standard notices."""
    out = list(KNOWN.items())
    out += [(name, f"{title}\n\n{body}") for name, (body, titles) in _TITLED.items() for title in titles]
    long = bodies()
    for name, text in long.items():
        out.append((name.split("~")[0], text))
        if _END in text:
            terms = text[: text.index(_END)]
            out += [(name.split("~")[0], terms), (name.split("~")[0], terms + _END)]
    for name, file, first, last in _NOTICES:
        text = first
        if file:
            start = long[file].index(first)
            text = long[file][start : long[file].index(last, start) + len(last)]
        out.append((f"{name} (notice)", text))
    return out
