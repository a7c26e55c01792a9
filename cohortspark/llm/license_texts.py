"""Templates of public licence texts and notices, as text with markup (see ``licenses``). Whole mandatory wording.

Whole licences of several pages are files in ``full_texts``, from their title to the end of their terms; addresses of the
publisher are optional in them.
"""

from importlib.resources import files

_VAR = '<<var;match=".+">>'
_COPY = f"<<beginOptional>>copyright <<beginOptional>>c<<endOptional>> {_VAR}<<endOptional>> "
_GNU = (
    " as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either version {v} of the License<<beginOptional>>,<<endOptional>> or <<beginOptional>>(<<endOptional>>at your option<<beginOptional>>)<<endOptional>> any later version. "
    "{it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
    "You should have received a copy of the {name} along with {it}"
)


def _gnu(name: str, version: str) -> str:
    """The notice that a program under one of the GNU licences carries."""
    it = '<<var;match=".+">>'
    return f"<<beginOptional>>{it} <<endOptional>>is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the {name}" + _GNU.format(v=version, it=it, name=name)


def _only(name: str, version: str) -> str:
    """The notice of a program under one version of a GNU licence alone."""
    return f"under the terms of the {name}<<beginOptional>>,<<endOptional>> version {version}<<beginOptional>> only<<endOptional>><<beginOptional>>,<<endOptional>> as published by the Free Software Foundation"


def _full(name: str) -> str:
    return (files(f"{__package__}.full_texts") / f"{name}.txt").read_text(encoding="utf-8")


_BSD_HEAD = _COPY + (
    "<<beginOptional>>all rights reserved<<endOptional>> Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = f"<<beginOptional>>3.<<endOptional>> Neither the name of {_VAR} may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    f'THIS SOFTWARE IS PROVIDED BY {_VAR} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    f"IN NO EVENT SHALL {_VAR} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)

#: Template text by label.
TEMPLATES = {
    # notices of one line: they name a licence and do not grant one
    "mit-notice": "<<beginOptional>>released<<endOptional>> under the MIT License",
    "apache-2.0-notice": "licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "<<beginOptional>>this work is<<endOptional>> licensed under the GNU General Public License,<<beginOptional>> either<<endOptional>> version 3",
    "gpl-2.0-notice": "<<beginOptional>>this work is<<endOptional>> licensed under the GNU General Public License,<<beginOptional>> either<<endOptional>> version 2",
    "cc-by-4.0": "licensed under<<beginOptional>> a<<endOptional>> CC BY 4.0",
    "cc-by-nc-4.0": "licensed under<<beginOptional>> a<<endOptional>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under<<beginOptional>> a<<endOptional>> CC BY-SA 4.0",
    "cc-by-nd-4.0": "licensed under<<beginOptional>> a<<endOptional>> CC BY-ND 4.0",
    "cc-by-4.0-line": f"licensed under <<beginOptional>>{'a'} <<endOptional>>Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-line": "licensed under <<beginOptional>>a <<endOptional>>Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-nc-4.0-line": "licensed under <<beginOptional>>a <<endOptional>>Creative Commons Attribution NonCommercial 4.0 International License",
    "cc0-1.0-line": f"To the extent possible under law, {_VAR} has waived all copyright and related or neighboring rights to {_VAR}",
    # notices and licences whole
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;match=".+">> except in compliance with the License. You may obtain a copy of the License at '
        "<<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "<<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0"
    ),
    "gpl-2.0-only": _only("GNU General Public License", "2"),
    "gpl-3.0-only": _only("GNU General Public License", "3"),
    "lgpl-2.1-only": _only("GNU Lesser General Public License", "2.1"),
    "gpl-2.0-or-later": _gnu("GNU General Public License", "2"),
    "gpl-3.0-or-later": _gnu("GNU General Public License", "3"),
    "lgpl-2.1-or-later": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-or-later": _gnu("GNU Lesser General Public License", "3"),
    "agpl-3.0-or-later": _gnu("GNU Affero General Public License", "3"),
    "mit": _COPY + (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files<<beginOptional>> (the "Software")<<endOptional>>, to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        f"IN NO EVENT SHALL {_VAR} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ),
    "isc": _COPY + (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        f'THE SOFTWARE IS PROVIDED "AS IS" AND {_VAR} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        f"IN NO EVENT SHALL {_VAR} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
    ),
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + _BSD_NAME + _BSD_TAIL,
}
#: Whole licences.
TEMPLATES |= {f"{name}-text": _full(name) for name in ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "mpl-2.0")}
