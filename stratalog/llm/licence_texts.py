"""Licence texts and standard notices. Published wordings under their SPDX identifiers.

A ``title`` is the head of a licence text. It counts only in files that are
named as licence files, as prose may name a licence too.
"""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""


def _gnu(subject: str, name: str, version: str, later: bool) -> str:
    choice = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return (
        f"{subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, {choice}. {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


_GNU = [
    ("GPL", "GNU General Public License", ("2.0", "3.0"), {"2.0": "Version 2, June 1991", "3.0": "Version 3, 29 June 2007"}),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0"), {"2.1": "Version 2.1, February 1999", "3.0": "Version 3, 29 June 2007"}),
    ("AGPL", "GNU Affero General Public License", ("3.0",), {"3.0": "Version 3, 19 November 2007"}),
]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives")]


def _generated() -> list[tuple[str, str, str]]:
    out = []
    for short, name, versions, dates in _GNU:
        for version in versions:
            spoken = version.removesuffix(".0")
            for later in (False, True):
                licence = f"{short}-{version}-{'or-later' if later else 'only'}"
                out += [(licence, "notice", _gnu(subject, name, spoken, later)) for subject in ("This program",)]
            out.append((f"{short}-{version}-only", "notice", f"This work is licensed under the {name}, version {spoken}."))
            out.append((f"{short}-{version}-only", "notice", f"Licensed under the {name}, version {spoken}."))
            out.append((f"{short}-{version}-only", "title", f"{name} {dates[version]}"))
    for short, name in _CC:
        out.append((f"CC-{short}-4.0", "notice", f"Licensed under CC {short} 4.0."))
        out.append((f"CC-{short}-4.0", "notice", f"This work is licensed under a Creative Commons {name} 4.0 International License."))
    return out


#: (SPDX identifier, kind, wording)
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "notice", _MIT_GRANT),
    ("MIT", "notice", f"{_MIT_GRANT} {_MIT_REST}"),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT license."),
    ("MIT", "title", "MIT License Copyright (c)"),
    ("BSD-2-Clause", "notice", f"{_BSD_HEAD} {_BSD_REST}"),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "notice", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-3-Clause", "notice", _BSD_THIRD),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("ISC", "notice", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_REST}"),
    ("0BSD", "notice", f"{_ISC}. {_ISC_REST}"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", _APACHE),
    ("Apache-2.0", "title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "title", "Mozilla Public License Version 2.0 1. Definitions"),
    ("EPL-2.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("Zlib", "notice", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "notice", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "notice", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide under CC0 1.0 Universal."),
    *_generated(),
]
