"""Public licence texts and notices, with the label and the phrase without which a match does not count."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_3_CLAUSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

BSD_4_CLAUSE = """All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Notices of the GNU family; the family's name and the version in figures decide.
GNU_NOTICE = """This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
GNU_ONLY = """This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."""
GNU_SHORT = "licensed under the GNU {name} version {version}"
GNU_SHORT_V = "licensed under the GNU {name} v{version}"
GNU_TITLE = "GNU {name} Version {version}, {date} Copyright (C) Free Software Foundation, Inc."
GNU = [
    ("gpl-2", "program", "General Public License", "2", "June 1991"), ("gpl-3", "program", "General Public License", "3", "29 June 2007"),
    ("lgpl-2-1", "library", "Lesser General Public License", "2.1", "February 1999"), ("lgpl-3", "library", "Lesser General Public License", "3", "29 June 2007"),
    ("agpl-3", "program", "Affero General Public License", "3", "19 November 2007"),
]

MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."""

UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

MPL_1_1 = """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""

WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"""

CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication."""

CC = "This work is licensed under a Creative Commons {name} {version} International License."
CC_SHORT = "Creative Commons {name} {version}"
CC_NAMES = [
    ("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"), ("cc-by-nd", "Attribution-NoDerivatives"), ("cc-by-nc", "Attribution-NonCommercial"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
]

#: What follows "SPDX-License-Identifier:".
SPDX = [
    ("mit", "MIT"), ("apache-2", "Apache-2.0"), ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("isc", "ISC"), ("zlib", "Zlib"), ("unlicense", "Unlicense"), ("mpl-2", "MPL-2.0"), ("bsl-1", "BSL-1.0"), ("cc0-1", "CC0-1.0"),
    *((label, f"{short}-{version}.0") for label, short, version in (("gpl-2", "GPL", "2"), ("gpl-3", "GPL", "3"), ("lgpl-3", "LGPL", "3"), ("agpl-3", "AGPL", "3"))), ("lgpl-2-1", "LGPL-2.1"),
    *((f"{label}-4", f"{label.upper()}-4.0") for label, _ in CC_NAMES),
]


def _gnu() -> list[tuple[str, str, list[str]]]:
    out = []
    for label, thing, name, version, date in GNU:
        own = {"thing": thing, "name": name, "version": version, "date": date}
        for form in (GNU_NOTICE, GNU_ONLY, GNU_SHORT, GNU_SHORT_V, GNU_TITLE):
            number = {GNU_NOTICE: f"version {version} of the license", GNU_SHORT_V: f"v{version}"}.get(form, f"version {version}")
            out.append((label, form.format(**own), [f"gnu {name}", number]))
    return out


#: (label, text, mandatory phrases). A phrase holds the words that set the licence apart from its neighbours.
LICENSES = [
    ("mit", MIT, ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("bsd-2", f"{BSD_2} {BSD_DISCLAIMER}", ["redistribution and use in source and binary forms", "redistributions of source code must retain"]),
    ("bsd-3", f"{BSD_2} {BSD_3_CLAUSE} {BSD_DISCLAIMER}", ["redistribution and use in source and binary forms", "to endorse or promote products derived from this software"]),
    ("bsd-4", f"{BSD_2} {BSD_4_CLAUSE} {BSD_3_CLAUSE} {BSD_DISCLAIMER}", ["redistribution and use in source and binary forms", "all advertising materials mentioning features"]),
    ("isc", ISC, ["permission to use copy modify and or distribute this software", "with or without fee is hereby granted"]),
    ("apache-2", APACHE, ["licensed under the apache license version 2 0"]),
    *_gnu(),
    ("mpl-2", MPL, ["mozilla public license v 2 0"]),
    ("mpl-1-1", MPL_1_1, ["mozilla public license version 1 1"]),
    ("zlib", ZLIB, ["permission is granted to anyone to use this software for any purpose"]),
    ("unlicense", UNLICENSE, ["unencumbered software released into the public domain"]),
    ("bsl-1", BOOST, ["any person or organization obtaining a copy of the software and accompanying documentation"]),
    ("wtfpl", WTFPL, ["want to public license"]),
    ("cc0-1", CC0, ["cc0 1 0 universal"]),
    *((f"{label}-{v[0]}", form.format(name=name, version=v), [f"creative commons {name} {v}"]) for label, name in CC_NAMES for v in ("3.0", "4.0") for form in (CC, CC_SHORT)),
    *((label, f"SPDX-License-Identifier: {name}", [f"spdx license identifier {name}"]) for label, name in SPDX),
]
