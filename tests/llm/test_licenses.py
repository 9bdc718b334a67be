import random
import re

from helixframe.llm import licenses
from helixframe.llm.licenses import WORD, Automaton
from helixframe.llm.words import hash_words


def as_regex(template):
    """Brute force: the template as a pattern over ' word word ' text."""
    out, end = "", 0
    for mark in [*licenses._MARK.finditer(template), None]:
        out += "".join(f"{w} " for w in WORD.findall(template[end:mark.start() if mark else None].lower()))
        if mark is None:
            return out
        end, name = mark.end(), mark[1]
        if name == "beginOptional":
            out += "(?:"
        elif name == "endOptional":
            out += ")?"
        elif m := re.fullmatch(r"var;(\d+)-(\d+)", name):
            out += rf"(?:\S+ ){{{m[1]},{m[2]}}}"
        else:
            out += "(?:" + "|".join("".join(f"{w} " for w in WORD.findall(v)) for v in name[4:].split("|")) + ")"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    words = WORD.findall(lower(text))
    labels, places = set(), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    more = set(labels)
    for label, template in licenses.TEMPLATES.items():
        pattern = re.compile(as_regex(template))
        if any(pattern.match(" ".join(words[i:]) + " ") for i in range(len(words))):
            more.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more))


LINES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "CC-BY CC BY",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed under", "cc",
    "Copyright (c) 2020 Some Body All rights reserved", "licensed under the Apache license two", "rights reserved", "general public",
    "licensed under a Creative Commons Attribution Share Alike 4.0 license",
]


def test_scan_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "...", "É ALL RIGHTS RESERVEDé all rights reserved", "x " * 50_000 + "cc by " * 3]
    texts += [" ".join(rng.choice([*LINES, "foo", "bar the", "this", "Permission"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(i % 300, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as labels", "2 as score")
    rows = licenses.scan_licenses(df.repartition(3)).collect()
    got = sorted((r.doc_id, r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels) for r in rows)
    want = sorted((i % 300, *(str(x) if k in (2, 3) else x for k, x in enumerate(brute(t)))) for i, t in enumerate(texts))
    assert got == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.places) for r in rows)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_optional_and_replaceable_regions():
    a = Automaton("one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> <<var;1-2>> <<var;x|y z>>")
    def accepts(text):
        return a.longest(hash_words(text.split()).tolist()) == len(text.split())
    assert accepts("one q x") and accepts("one two q q x") and accepts("one two three q y z")
    assert not accepts("one three two y") and not accepts("two q x") and not accepts("one q y")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
BSD = ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. """, """* Neither the name of the copyright holder nor the names of
its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """, """THIS
SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""]


def test_whole_license_texts_are_mandatory():
    def whole(label, text):
        words = WORD.findall(lower(text))
        return Automaton(licenses.TEMPLATES[label]).longest(hash_words(words).tolist()) == len(words)
    for label, text in [("mit-permission", MIT), ("isc-permission", ISC), ("bsd-redistribution", "".join(BSD)), ("bsd-redistribution", BSD[0] + BSD[2])]:
        assert whole(label, text)
        automaton = Automaton(licenses.TEMPLATES[label])
        words = WORD.findall(lower(text))
        assert automaton.longest(hash_words(words[:60] + ["never"] + words[60:]).tolist()) == 0
        assert automaton.longest(hash_words(words[:-1]).tolist()) == 0
    assert not whole("bsd-redistribution", BSD[0])
