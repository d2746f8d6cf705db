"""Licence scans by sentence rules: known sentences become identifiers, and rules are ordered sequences of them."""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import product
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and of notices that name them, by identifier.
SENTENCES = {
    "apache-notice": 'Licensed under the Apache License, Version 2.0',
    "apache-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc0-notice": "Licensed under CC0 1.0",
    "unlicense-grant": "This is free and unencumbered software released into the public domain",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "lgpl2.1-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-grant": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "psf-parties": 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation',
    "cc0-deed": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc-by-deed": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-deed": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-deed": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-deed": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-deed": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-gpl3-only": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl2": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl2-only": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-lgpl2.1": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-lgpl3": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-agpl3": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-epl2": "SPDX-License-Identifier: EPL-2.0",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "spdx-cc0": "SPDX-License-Identifier: CC0-1.0",
    "bsd-endorse-other": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "gpl2-only-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-only-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "lgpl2-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "apache-title": "Apache License Version 2.0, January 2004",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl2-title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "artistic2-terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "afl3-notice": "Licensed under the Academic Free License version 3.0",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc-by-3-deed": "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    "cc-by-sa-3-deed": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "cc-by-nc-3-deed": "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License",
    "cc-by-nd-3-deed": "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License",
    "cc-by-nc-sa-3-deed": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License",
}

#: Further forms of sentences. <a|b|> is one of these words or none, {n} up to n words of any kind (a holder's name).
FORMS = {
    "apache-notice": ["<Licensed|Released|Distributed|Available> under the Apache License <|Version|v> 2.0"],
    "apache-notice-the": ['<This file is licensed|This software is licensed|This project is licensed|The ASF licenses this file to You> under the Apache License, Version 2.0 (the "License")'],
    "apache-compliance": ["you may not use this <work|software|project> except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at <http|https> www.apache.org/licenses/LICENSE-2.0 <|txt|html>"],
    "mit-notice": ["<Distributed|Available|Published> under the MIT License"],
    "mit-notice-licensed": ["This <project|software|code|package|library> is licensed under the MIT License"],
    "mit-grant": [SENTENCES["mit-grant"].replace("the rights", "on the rights")],
    "mit-condition": ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit-as-is": [SENTENCES["mit-as-is"].replace("AND NONINFRINGEMENT", "<AND|> <NONINFRINGEMENT|NON-INFRINGEMENT> <|OF THIRD PARTY RIGHTS>")],
    "mit-liability": [SENTENCES["mit-liability"].replace("THE AUTHORS OR COPYRIGHT HOLDERS", "{16}")],
    "isc-grant": [SENTENCES["isc-grant"].replace("and/or", "and")],
    "0bsd-grant": [SENTENCES["0bsd-grant"].replace("and/or", "and")],
    "bsd-source": [SENTENCES["bsd-source"].replace("Redistributions", "<Redistribution|Redistributions>") + " <|in this position and unchanged>"],
    "bsd-binary": [SENTENCES["bsd-binary"].replace("Redistributions", "Redistribution")],
    "bsd-endorse": ["Neither the <name|names> of {16} nor the names of <its|their|the|> contributors may be used to endorse or promote products derived from this software without <specific|> prior written permission"],
    "bsd-endorse-other": [
        "The <name|names> of {16} may not be used to endorse or promote products derived from this software without <specific prior|prior|specific> written permission",
        "Neither the <name|names> of {40} endorse or promote products derived from this software without <specific prior|prior|specific> written permission",
    ],
    "bsd-as-is": [SENTENCES["bsd-as-is"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "{16}")],
    "bsd-liability": [SENTENCES["bsd-liability"].replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "{16}")],
    "gpl2-grant": [SENTENCES["gpl2-grant"].replace("This program", "<This file|This software|It>")],
    "gpl3-grant": [SENTENCES["gpl3-grant"].replace("This program", "<This file|This software|It>")],
    "gpl2-only-grant": [SENTENCES["gpl2-only-grant"].replace("version 2", "version 2 only"), SENTENCES["gpl2-grant"].replace("either version 2 of the License, or (at your option) any later version", "version 2 of the License")],
    "gpl3-only-grant": [SENTENCES["gpl3-only-grant"].replace("version 3", "version 3 only"), SENTENCES["gpl3-grant"].replace("either version 3 of the License, or (at your option) any later version", "version 3 of the License")],
    "gpl-hope": [SENTENCES["gpl-hope"].replace("This program", "<This file|This software|It>")],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl1-notice": [SENTENCES["epl1-notice"].replace("http:", "https:")],
    "epl2-notice": [SENTENCES["epl2-notice"].replace("https:", "http:")],
}

#: Rule name, licence, and the identifiers that must follow one another among a text's known sentences.
RULES = [
    ("apache-2.0-notice", "Apache-2.0", ["apache-notice"]),
    ("apache-2.0-notice-the", "Apache-2.0", ["apache-notice-the"]),
    ("apache-2.0-header", "Apache-2.0", ["apache-notice-the", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("apache-2.0-spdx", "Apache-2.0", ["spdx-apache"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("mit-notice-licensed", "MIT", ["mit-notice-licensed"]),
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "mit-as-is"]),
    ("mit-spdx", "MIT", ["spdx-mit"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-3-spdx", "BSD-3-Clause", ["spdx-bsd3"]),
    ("gpl-3-notice", "GPL-3.0", ["gpl3-notice"]),
    ("gpl-3-header", "GPL-3.0", ["gpl3-grant", "gpl-hope"]),
    ("gpl-3-spdx", "GPL-3.0", ["spdx-gpl3"]),
    ("gpl-2-header", "GPL-2.0", ["gpl2-grant", "gpl-hope"]),
    ("mpl-2-notice", "MPL-2.0", ["mpl2-notice"]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("cc-by-notice", "CC-BY-4.0", ["cc-by-notice"]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("cc0-notice", "CC0-1.0", ["cc0-notice"]),
    ("unlicense-text", "Unlicense", ["unlicense-grant"]),
    ("gpl-3-spdx-only", "GPL-3.0", ["spdx-gpl3-only"]),
    ("gpl-2-spdx", "GPL-2.0", ["spdx-gpl2"]),
    ("gpl-2-spdx-only", "GPL-2.0", ["spdx-gpl2-only"]),
    ("lgpl-2.1-header", "LGPL-2.1", ["lgpl2.1-grant", "lgpl-hope"]),
    ("lgpl-2.1-spdx", "LGPL-2.1", ["spdx-lgpl2.1"]),
    ("lgpl-3-header", "LGPL-3.0", ["lgpl3-grant", "lgpl-hope"]),
    ("lgpl-3-spdx", "LGPL-3.0", ["spdx-lgpl3"]),
    ("agpl-3-header", "AGPL-3.0", ["agpl3-grant", "gpl-hope"]),
    ("agpl-3-spdx", "AGPL-3.0", ["spdx-agpl3"]),
    ("mpl-2-header", "MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("mpl-2-spdx", "MPL-2.0", ["spdx-mpl2"]),
    ("epl-2-notice", "EPL-2.0", ["epl2-notice"]),
    ("epl-2-spdx", "EPL-2.0", ["spdx-epl2"]),
    ("bsd-2-spdx", "BSD-2-Clause", ["spdx-bsd2"]),
    ("isc-spdx", "ISC", ["spdx-isc"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("zlib-spdx", "Zlib", ["spdx-zlib"]),
    ("bsl-1.0-text", "BSL-1.0", ["bsl-grant"]),
    ("psf-2.0-text", "PSF-2.0", ["psf-parties"]),
    ("cc0-deed", "CC0-1.0", ["cc0-deed"]),
    ("cc0-spdx", "CC0-1.0", ["spdx-cc0"]),
    ("cc-by-deed", "CC-BY-4.0", ["cc-by-deed"]),
    ("cc-by-sa-deed", "CC-BY-SA-4.0", ["cc-by-sa-deed"]),
    ("cc-by-nc-deed", "CC-BY-NC-4.0", ["cc-by-nc-deed"]),
    ("cc-by-nd-deed", "CC-BY-ND-4.0", ["cc-by-nd-deed"]),
    ("cc-by-nc-sa-deed", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa-deed"]),
    ("mit-text-short", "MIT", ["mit-grant", "mit-condition"]),
    ("bsd-3-text-other", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-other"]),
    ("bsd-4-text", "BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("bsd-4-text-other", "BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse-other"]),
    ("0bsd-text", "0BSD", ["0bsd-grant"]),
    ("gpl-2-grant", "GPL-2.0", ["gpl2-grant"]),
    ("gpl-3-grant", "GPL-3.0", ["gpl3-grant"]),
    ("gpl-2-only-grant", "GPL-2.0", ["gpl2-only-grant"]),
    ("gpl-3-only-grant", "GPL-3.0", ["gpl3-only-grant"]),
    ("lgpl-2-grant", "LGPL-2.0", ["lgpl2-grant"]),
    ("lgpl-2.1-grant", "LGPL-2.1", ["lgpl2.1-grant"]),
    ("lgpl-3-grant", "LGPL-3.0", ["lgpl3-grant"]),
    ("agpl-3-grant", "AGPL-3.0", ["agpl3-grant"]),
    ("apache-2.0-title", "Apache-2.0", ["apache-title"]),
    ("gpl-2-title", "GPL-2.0", ["gpl2-title"]),
    ("gpl-3-title", "GPL-3.0", ["gpl3-title"]),
    ("lgpl-2-title", "LGPL-2.0", ["lgpl2-title"]),
    ("lgpl-2.1-title", "LGPL-2.1", ["lgpl2.1-title"]),
    ("lgpl-3-title", "LGPL-3.0", ["lgpl3-title"]),
    ("agpl-3-title", "AGPL-3.0", ["agpl3-title"]),
    ("epl-1-notice", "EPL-1.0", ["epl1-notice"]),
    ("ofl-1.1-notice", "OFL-1.1", ["ofl-notice"]),
    ("artistic-2-terms", "Artistic-2.0", ["artistic2-terms"]),
    ("afl-3-notice", "AFL-3.0", ["afl3-notice"]),
    ("wtfpl-title", "WTFPL", ["wtfpl-title"]),
    ("cc-by-3-deed", "CC-BY-3.0", ["cc-by-3-deed"]),
    ("cc-by-sa-3-deed", "CC-BY-SA-3.0", ["cc-by-sa-3-deed"]),
    ("cc-by-nc-3-deed", "CC-BY-NC-3.0", ["cc-by-nc-3-deed"]),
    ("cc-by-nd-3-deed", "CC-BY-ND-3.0", ["cc-by-nd-3-deed"]),
    ("cc-by-nc-sa-3-deed", "CC-BY-NC-SA-3.0", ["cc-by-nc-sa-3-deed"]),
]

_END = "[.;!?]+([ \\t\\r\\n]|$)"
_STOP = "[.;:!?]+[ \\t\\r\\n]"
#: A label of a list at a part's start: a short number, a letter or a small Roman number before a closing bracket.
_LABEL = "\n[^A-Za-z0-9\n]*([0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4})[)]"
#: Letters of a word that may stand for a placeholder, at most.
WORD = 40


def normalised(sentence: str) -> str:
    parts = re.sub(_END, "\n", sentence).split("\n")
    return " ".join(filter(None, (re.sub("[^A-Za-z0-9]+", " ", p).strip().lower() for p in parts)))


@cache
def variants() -> list[tuple[str, int, str, str]]:
    """(head, most, tail, id) of every form, those with most fixed letters first; without a placeholder most is 0 and tail empty."""
    out: dict[tuple[str, int, str], str] = {}
    for key, form in [*SENTENCES.items(), *((k, f) for k, forms in FORMS.items() for f in forms)]:
        for words in product(*(c.split("|") for c in re.findall("<([^>]*)>", form))):
            rest = iter(words)
            head, _, tail = re.sub("<[^>]*>", lambda _: next(rest), form).partition("{")  # noqa: B023
            most, _, tail = tail.partition("}")
            out.setdefault((normalised(head), int(most or 0), normalised(tail)), key)
    return sorted(((*v, k) for v, k in out.items()), key=lambda v: (-len(v[0]) - len(v[2]), v))


def telling_words() -> list[str]:
    """Few words of which every known sentence contains one; texts with none of them have no known sentence."""
    left = {f"{head} {tail}" for head, _, tail, _ in variants()}
    chosen = []
    while left:
        best = max(sorted({w for s in left for w in s.split()}), key=lambda w: (sum(w in s for s in left) if len(w) > 6 else 0, len(w)))
        chosen.append(best)
        left = {s for s in left if best not in s}
    return chosen


def pattern(head: str, most: int, tail: str, between: str) -> str:
    gap = f"(?:{between}[a-z0-9]{{1,{WORD}}}){{1,{most}}}?{between}{tail.replace(' ', between)}" if most else ""
    return head.replace(" ", between) + gap


def patterns() -> str:
    """A regular expression of all known sentences, the longest first; between words is a space, or a bar where a part ends."""
    return "|".join(pattern(*v[:3], "[ |]") for v in variants())


def longer(seq: list[str], rules: list) -> list[list[str]]:
    """The rules' sequences of which ``seq`` is a part, the longest first."""
    k = len(seq)
    return sorted((s for _, _, s in rules if len(s) > k and any(s[i : i + k] == seq for i in range(len(s) - k + 1))), key=len, reverse=True)


def marked(seq: list[str]) -> str:
    return "".join(f"<{i}>" for i in seq)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list | None = None) -> DataFrame:
    """(id, n_sentences, sentence_ids, rules, licenses) for every row.

    A text's parts end at [.;:!?] before white space and at line ends, and start after a list's label such as "(a)"; a part
    is its letters and digits A-Z, a-z, 0-9 in lower case, joined by spaces. Known sentences are found wherever they start
    and end with a part, over any number of parts, in any of their forms: a placeholder stands for one word up to its bound,
    each of at most 40 letters. sentence_ids are theirs in order, of those that start together the one with most fixed
    letters, and a rule matches if its
    identifiers follow one another there, other than inside a longer rule's. Lists are joined by commas, rules in the
    order of the table. Null and empty texts have none; repeated rows give repeated results; an empty table gives an
    empty one; other columns aren't read, so their names can't clash. A text takes few times its size, however long.
    """
    rules = RULES if rules is None else rules
    known = F.create_map(*(F.lit(x) for head, most, _, k in variants() if not most for x in (head, k)))
    gapped = [v for v in variants() if v[1]]

    def named(found):
        flat = F.translate(found, "|", " ")
        of_form = reduce(lambda c, v: c.when(flat.rlike(f"^{pattern(*v[:3], ' ')}$"), F.lit(v[3])), gapped, F.when(F.lit(False), F.lit("")))
        return F.coalesce(F.try_element_at(known, flat), of_form)

    # Words with a space between them, or a bar where a part ends.
    lines = F.regexp_replace(F.regexp_replace(F.concat(F.lit("\n"), F.col("_text"), F.lit("\n")), _STOP, "\n"), _LABEL, "\n")
    words = F.lower(F.regexp_replace(F.regexp_replace(lines, "[^A-Za-z0-9\n]+", " "), " ?\n[ \n]*", "|"))
    low = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.lower(text_col).alias("_low"))
    telling = reduce(or_, (F.contains(F.col("_low"), F.lit(w)) for w in telling_words()))
    rows = low.select("_key", F.when(telling, words).alias("_w"))
    found = F.regexp_extract_all("_w", F.lit(f"[|](?=({patterns()})[|])"), F.lit(1))
    ids = F.transform(found, named)
    rows = rows.select("_key", F.coalesce(ids, F.array().cast("array<string>")).alias("_ids"))
    rows = rows.withColumn("_line", F.when(F.size("_ids") > 0, F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">"))).otherwise(""))
    matches = [F.when(F.contains(reduce(lambda c, s: F.replace(c, F.lit(marked(s)), F.lit("<>")), longer(seq, rules), F.col("_line")), F.lit(marked(seq))), F.struct(F.lit(name).alias("rule"), F.lit(key).alias("license"))) for name, key, seq in rules]
    rows = rows.withColumn("_found", F.when(F.col("_line") != "", F.filter(F.array(*matches), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<rule:string,license:string>>")))
    return rows.select(
        F.col("_key").alias(id_col),
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.col("_found.rule"), ",").alias("rules"),
        F.array_join(F.sort_array(F.array_distinct(F.col("_found.license"))), ",").alias("licenses"),
    )


def oracle_sql() -> str:
    """The same over all texts: every part that starts like a sentence is compared with all forms, as far as the longest reaches.

    A placeholder is tried at every number of words, by lists of words.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quote(head)}, {gap}, {quote(tail)}, {quote(k)})" for i, (head, gap, tail, k) in enumerate(variants()))
    first, most = sorted({v[0].split()[0] for v in variants()}), max(len(head) + len(tail) + gap * (WORD + 1) for head, gap, tail, _ in variants())
    tests = []
    for i, (name, key, seq) in enumerate(RULES):
        line = reduce(lambda c, s: f"replace({c}, {quote(marked(s))}, '<>')", longer(seq, RULES), "line")
        tests.append(f"select doc_id, {i} as nth, {quote(name)} as rule, {quote(key)} as license from seqs where contains({line}, {quote(marked(seq))})")
    return f"""
with known(rank, head, gap, tail, id) as (values {known}),
texts as (select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(10) || text || chr(10), '[.;:!?]+[ \\t\\r\\n]', chr(10), 'g'),
  '\\n[^A-Za-z0-9\\n]*([0-9]{{1,3}}|[A-Za-z]|[ivxIVX]{{1,4}})[)]', chr(10), 'g'),
  '[^A-Za-z0-9\\n]+', ' ', 'g'), ' ?\\n[ \\n]*', '|', 'g')) as w from documents where text is not null),
split as (select doc_id, w, unnest(string_split(w, '|')) as part, generate_subscripts(string_split(w, '|'), 1) as nth from texts),
placed as (select doc_id, w, part, sum(length(part) + 1) over (partition by doc_id order by nth rows unbounded preceding) - length(part) as pos from split),
starts as (select doc_id, pos, substr(w, pos::bigint, {most + 1}) as part from placed where split_part(part, ' ', 1) in ({", ".join(map(quote, first))})),
near as (select doc_id, pos, part, rank, head, gap, tail, id from starts join known on starts_with(translate(part, '|', ' '), head)),
plain as (select doc_id, pos, rank, id from near where gap = 0 and substr(part, length(head) + 1, 1) = '|'),
words as (select doc_id, pos, part, rank, gap, tail, id, string_split(translate(substr(part, length(head) + 2), '|', ' '), ' ') as w from near where gap > 0 and substr(part, length(head) + 1, 1) in (' ', '|')),
tried as (select * exclude (w), w[1:g] as between, array_to_string(w[g + 1:], ' ') as after from (select *, unnest(range(1, gap + 1)) as g from words)),
gaps as (select doc_id, pos, rank, id from tried where starts_with(after, tail) and substr(part, length(part) - length(after) + length(tail) + 1, 1) = '|' and list_max(list_transform(between, lambda x: length(x))) <= {WORD}),
hits as (select doc_id, pos, arg_min(id, rank) as id from (select * from plain union all select * from gaps) group by 1, 2),
seqs as (select doc_id, count(*) as n, string_agg(id, ',' order by pos) as ids, string_agg('<' || id || '>', '' order by pos) as line from hits group by 1),
found as ({" union all ".join(tests)}),
matched as (select doc_id, string_agg(rule, ',' order by nth) as rules, array_to_string(list_sort(list(distinct license)), ',') as licenses from found group by 1)
select d.doc_id, coalesce(n, 0) as n_sentences, coalesce(ids, '') as sentence_ids, coalesce(rules, '') as rules, coalesce(licenses, '') as licenses
from documents d left join seqs using (doc_id) left join matched using (doc_id)
"""
