"""Wordings of licences that files are compared with.

Fixed values: the public wordings by which licences are declared (``header``), the first lines of
long licences (``title``), and short licences as a whole (``whole``).  Of templates that fit equally
well the longer one is taken, then the first.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    name: str
    kind: str
    wording: str


_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files"
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met"
)
_BSD_TWO = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_GNU_GRANT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU {} as published by the Free Software Foundation"
)
_GNU_CHOICE = ", either version {} of the License, or (at your option) any later version"
_GNU_TITLE = "GNU {} Version {} Copyright (C) {} Free Software Foundation, Inc."
_CC_TITLE = (
    "{} 4.0 International Creative Commons Corporation (Creative Commons) is not a law firm and does not "
    "provide legal services or legal advice"
)
_GPL, _LGPL, _AGPL = (
    "General Public License",
    "Lesser General Public License",
    "Affero General Public License",
)

TEMPLATES = (
    Template("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0"),
    Template(
        "Apache-2.0",
        "header",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License",
    ),
    Template("MIT", "header", "Released under the MIT License"),
    Template("MIT", "header", _MIT_GRANT),
    Template("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3"),
    Template("GPL-3.0", "header", _GNU_GRANT.format(_GPL)),
    Template("GPL-3.0", "header", _GNU_GRANT.format(_GPL) + _GNU_CHOICE.format(3)),
    Template("GPL-2.0", "header", _GNU_GRANT.format(_GPL) + _GNU_CHOICE.format(2)),
    Template("LGPL-3.0", "header", _GNU_GRANT.format(_LGPL) + _GNU_CHOICE.format(3)),
    Template("LGPL-2.1", "header", _GNU_GRANT.format(_LGPL) + _GNU_CHOICE.format("2.1")),
    Template("AGPL-3.0", "header", _GNU_GRANT.format(_AGPL) + _GNU_CHOICE.format(3)),
    Template("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0"),
    Template(
        "CC-BY-4.0",
        "header",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    Template("BSD-3-Clause", "header", _BSD_GRANT),
    Template(
        "MPL-2.0",
        "header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    Template("All-Rights-Reserved", "header", "All rights reserved"),
    Template(
        "Apache-2.0",
        "title",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ "
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    Template("GPL-3.0", "title", _GNU_TITLE.format(_GPL, "3, 29 June 2007", 2007)),
    Template("GPL-2.0", "title", _GNU_TITLE.format(_GPL, "2, June 1991", "1989, 1991")),
    Template("LGPL-3.0", "title", _GNU_TITLE.format(_LGPL, "3, 29 June 2007", 2007)),
    Template("LGPL-2.1", "title", _GNU_TITLE.format(_LGPL, "2.1, February 1999", "1991, 1999")),
    Template("AGPL-3.0", "title", _GNU_TITLE.format(_AGPL, "3, 19 November 2007", 2007)),
    Template("MPL-2.0", "title", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor"),
    Template("CC-BY-4.0", "title", _CC_TITLE.format("Attribution")),
    Template("CC-BY-SA-4.0", "title", _CC_TITLE.format("Attribution-ShareAlike")),
    Template("CC-BY-NC-4.0", "title", _CC_TITLE.format("Attribution-NonCommercial")),
    Template("CC0-1.0", "title", "Creative Commons Legal Code CC0 1.0 Universal"),
    Template(
        "MIT",
        "whole",
        _MIT_GRANT
        + ' (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template("BSD-2-Clause", "whole", _BSD_GRANT + _BSD_TWO + _BSD_END),
    Template("BSD-3-Clause", "whole", _BSD_GRANT + _BSD_TWO + _BSD_THIRD + _BSD_END),
    Template(
        "ISC",
        "whole",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    Template(
        "Unlicense",
        "whole",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE. For more information, please refer to <https://unlicense.org>",
    ),
)
