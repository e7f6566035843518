"""Templates of licence texts, notices and statements, in short lines."""

_MIT_GRANT = (
    "Permission is hereby granted, free of "
    "charge, to any person obtaining a copy "
    "of this software and associated "
    "documentation files (the \"Software\"), to "
    "deal in the Software without restriction, "
    "including without limitation the rights to "
    "use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies "
    "of the Software, and to permit persons to "
    "whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_NOTICE = (
    "The above copyright notice and this "
    "permission notice shall be included in all "
    "copies or substantial portions of the "
    "Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
    "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
    "A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or "
    "distribute this software for any purpose "
    "with or without fee is hereby granted, "
    "provided that the above copyright notice "
    "and this permission notice appear in all "
    "copies."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
    "AUTHOR DISCLAIMS ALL WARRANTIES WITH "
    "REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and "
    "binary forms, with or without "
    "modification, are permitted provided that "
    "the following conditions are met:"
)
_BSD_TWO = (
    "1. Redistributions of source code must "
    "retain the above copyright notice, this "
    "list of conditions and the following "
    "disclaimer. 2. Redistributions in binary "
    "form must reproduce the above copyright "
    "notice, this list of conditions and the "
    "following disclaimer in the documentation "
    "and/or other materials provided with the "
    "distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright "
    "holder nor the names of its contributors "
    "may be used to endorse or promote products "
    "derived from this software without "
    "specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
    "HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
    "EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
    "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
    "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version "
    "2.0 (the \"License\"); you may not use this "
    "file except in compliance with the "
    "License. You may obtain a copy of the "
    "License at "
    "http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or "
    "agreed to in writing, software distributed "
    "under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific "
    "language governing permissions and "
    "limitations under the License."
)


def _gnu(name: str, version: str) -> str:
    """The notice of a licence of the GNU family."""
    return (
        "This program is free software: you can "
        "redistribute it and/or modify it under "
        f"the terms of the {name} as published "
        "by the Free Software Foundation, either "
        f"version {version} of the License, or "
        "(at your option) any later version. "
        "This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS "
        f"FOR A PARTICULAR PURPOSE. See the {name} "
        "for more details. You should have "
        f"received a copy of the {name} along "
        "with this program. If not, see "
        "https://www.gnu.org/licenses/."
    )


_UNLICENSE = (
    "This is free and unencumbered software "
    "released into the public domain. Anyone is "
    "free to copy, modify, publish, use, "
    "compile, sell, or distribute this "
    "software, either in source code form or as "
    "a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any "
    "means."
)
_MPL = (
    "This Source Code Form is subject to the "
    "terms of the Mozilla Public License, v. "
    "2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain "
    "one at https://mozilla.org/MPL/2.0/."
)
_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
_CREATIVE = {
    "CC-BY-4.0": ("CC BY 4.0", "Attribution"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike"),
}

TEMPLATES = {
    "MIT/text": " ".join((_MIT_GRANT, _MIT_NOTICE, _MIT_WARRANTY)),
    "MIT/titled text": " ".join(("MIT License", _MIT_GRANT, _MIT_NOTICE, _MIT_WARRANTY)),
    "MIT/grant": _MIT_GRANT,
    "MIT/warranty": _MIT_WARRANTY,
    "MIT/statement": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/project": "This project is licensed under the MIT License.",
    "ISC/text": f"{_ISC_GRANT} {_ISC_WARRANTY}",
    "ISC/grant": _ISC_GRANT,
    "BSD-2-Clause/text": " ".join((_BSD_HEAD, _BSD_TWO, _BSD_WARRANTY)),
    "BSD-3-Clause/text": " ".join((_BSD_HEAD, _BSD_TWO, _BSD_THIRD, _BSD_WARRANTY)),
    "BSD/warranty": _BSD_WARRANTY,
    "BSD/statement": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0/notice": _APACHE_NOTICE,
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0/notice": _gnu(_GPL, "2"),
    "GPL-3.0/notice": _gnu(_GPL, "3"),
    "LGPL-3.0/notice": _gnu(_LGPL, "3"),
    "AGPL-3.0/notice": _gnu(_AGPL, "3"),
    "GPL-2.0/statement": f"This work is licensed under the {_GPL}, version 2.",
    "GPL-3.0/statement": f"This work is licensed under the {_GPL}, version 3.",
    "LGPL-3.0/statement": f"This work is licensed under the {_LGPL}, version 3.",
    "AGPL-3.0/statement": f"This work is licensed under the {_AGPL}, version 3.",
    "MPL-2.0/notice": _MPL,
    "Unlicense/text": _UNLICENSE,
    "Reserved/statement": "All rights reserved.",
    "Reserved/copyright": "Copyright. All rights reserved.",
} | {f"{k}/statement": f"Licensed under {short}." for k, (short, _) in _CREATIVE.items()} | {
    f"{k}/work": f"This work is licensed under a Creative Commons {long} 4.0 International License." for k, (_, long) in _CREATIVE.items()
} | {
    "0BSD/text": (
        "Permission to use, copy, modify, and/or "
        "distribute this software for any purpose "
        "with or without fee is hereby granted. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE "
        "AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "Zlib/text": (
        "This software is provided 'as-is', without "
        "any express or implied warranty. In no "
        "event will the authors be held liable for "
        "any damages arising from the use of this "
        "software. Permission is granted to anyone "
        "to use this software for any purpose, "
        "including commercial applications, and to "
        "alter it and redistribute it freely, "
        "subject to the following restrictions: 1. "
        "The origin of this software must not be "
        "misrepresented; you must not claim that "
        "you wrote the original software. If you "
        "use this software in a product, an "
        "acknowledgment in the product "
        "documentation would be appreciated but is "
        "not required. 2. Altered source versions "
        "must be plainly marked as such, and must "
        "not be misrepresented as being the "
        "original software. 3. This notice may not "
        "be removed or altered from any source "
        "distribution."
    ),
    "BSL-1.0/text": (
        "Permission is hereby granted, free of "
        "charge, to any person or organization "
        "obtaining a copy of the software and "
        "accompanying documentation covered by this "
        "license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare "
        "derivative works of the Software, and to "
        "permit third-parties to whom the Software "
        "is furnished to do so, all subject to the "
        "following: The copyright notices in the "
        "Software and this entire statement, "
        "including the above license grant, this "
        "restriction and the following disclaimer, "
        "must be included in all copies of the "
        "Software, in whole or in part, and all "
        "derivative works of the Software, unless "
        "such copies or derivative works are solely "
        "in the form of machine-executable object "
        "code generated by a source language "
        "processor."
    ),
    "BSL-1.0/notice": (
        "Distributed under the Boost Software "
        "License, Version 1.0. (See accompanying "
        "file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
    "CC0-1.0/statement": (
        "To the extent possible under law, the "
        "author has waived all copyright and "
        "related or neighboring rights to this "
        "work."
    ),
    "CC0-1.0/licensed": (
        "Licensed under CC0 1.0 Universal."
    ),
    "EPL-2.0/notice": (
        "This program and the accompanying "
        "materials are made available under the "
        "terms of the Eclipse Public License 2.0 "
        "which is available at "
        "https://www.eclipse.org/legal/epl-2.0"
    ),
    "EPL-2.0/statement": (
        "This work is licensed under the Eclipse "
        "Public License, version 2.0."
    ),
    "Artistic-2.0/statement": (
        "This is free software, licensed under: The "
        "Artistic License 2.0"
    ),
    "Artistic-2.0/terms": (
        "You can redistribute it and/or modify it "
        "under the terms of the Artistic License "
        "2.0."
    ),
}
