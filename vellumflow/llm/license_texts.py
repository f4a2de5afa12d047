"""Signatures by sentences of licenses and notices, each written out by hand: keyword, pattern, label, priority, score.

The keyword is text that every match of the pattern contains. Patterns are matched without regard to case; a space stands for a gap that
may go over lines. Priority 2 names one license, 3 and 4 a family or a common sentence of several, 5 to 7 a mere notice.
"""

from __future__ import annotations

TEXTS: tuple[tuple[str, str, str, int, float], ...] = (
    # MIT, ISC and other short permissions
    ("hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", "mit", 2, 0.95),
    ("permission notice", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions", "mit", 2, 0.95),
    ("deal in the software", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify", "mit", 2, 0.95),
    ("copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability", "mit", 3, 0.85),
    ("without warranty", r"the software is provided \"?as is\"?, without warranty of any kind, express or implied", "mit", 3, 0.8),
    ("good, not evil", r"the software shall be used for good, not evil", "json", 2, 0.95),
    ("hereby granted", r"permission to use, copy, modify, (?:and/or|and|or) distribute this software for any purpose with or without fee is hereby granted", "isc", 2, 0.95),
    ("disclaims all warranties", r"the software is provided \"?as is\"? and (?:the author|isc|internet systems consortium(?:, inc\.)?) disclaims all warranties", "isc", 2, 0.9),
    ("permission to use, copy, modify", r"permission to use, copy, modify,? (?:and )?distribute,? (?:and sell )?this software and its documentation for any purpose", "hpnd", 3, 0.85),
    ("supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation", "hpnd", 3, 0.85),
    ("otherwise to promote the sale", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software", "x11", 2, 0.95),
    ("hereby granted", r"permission is hereby granted, without written agreement and without license or royalty fees", "mit-modern", 2, 0.95),
    ("hereby granted", r"permission is hereby granted to use, copy, modify, and(?:/or)? distribute this (?:package|source code)", "permissive", 4, 0.7),
    ("copying and distribution of this file", r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty", "fsfap", 2, 0.95),
    ("in any medium without royalty", r"are permitted in any medium without royalty provided the copyright notice and this notice are preserved", "fsfap", 2, 0.95),
    ("unlimited permission to copy", r"gives unlimited permission to copy and/or distribute it, with or without modifications, as long as this notice is preserved", "fsfullr", 2, 0.95),
    # BSD
    ("redistribution and use in source", r"redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", 3, 0.9),
    ("redistributions of source code", r"redistributions of source code must retain the above copyright notice", "bsd", 3, 0.9),
    ("redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", "bsd", 3, 0.9),
    ("endorse or promote products", r"neither the names? of [^\n]{1,120} (?:may|can) be used to endorse or promote products derived from this software", "bsd-3-clause", 2, 0.95),
    ("endorse or promote products", r"(?:may|must) not be used to endorse or promote products derived from this software without", "bsd-3-clause", 3, 0.85),
    ("all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause", 2, 0.95),
    ("copyright holders and contributors", r"this software is provided by the copyright holders and contributors \"?as is\"? and any express or implied warranties", "bsd", 3, 0.9),
    ("regents and contributors", r"this software is provided by the regents and contributors ['\"`]*as is", "bsd", 3, 0.9),
    ("views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors", "bsd-2-clause-views", 2, 0.95),
    ("nuclear facility", r"is not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility", "bsd-3-clause-no-nuclear", 2, 0.95),
    ("complete source code", r"redistributions in any form must be accompanied by information on how to obtain complete source code", "sleepycat", 2, 0.95),
    ("bsd-style license", r"use of this source code is governed by a bsd-style license", "bsd", 3, 0.9),
    ("mit-style license", r"use of this source code is governed by an? mit-style license", "mit", 3, 0.9),
    # Apache
    ("apache license", r"licensed under the apache license, version 2\.0 \(the \"?license\"?\)", "apache-2.0", 2, 1.0),
    ("in compliance with the license", r"you may not use this file except in compliance with the license", "apache-2.0", 3, 0.85),
    ("unless required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the license", "apache-2.0", 3, 0.85),
    ("warranties or conditions", r"on an \"?as is\"? basis, without warranties or conditions of any kind, either express or implied", "apache-2.0", 3, 0.85),
    ("grant of patent license", r"grant of patent license\. subject to the terms and conditions of this license", "apache-2.0", 2, 0.95),
    ("apache software foundation", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", "apache-2.0", 2, 0.95),
    ("this product includes software", r"this product includes software developed (?:by|at) the apache (?:software foundation|group)", "apache", 3, 0.8),
    # GNU
    ("free software", r"is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e", "gpl", 2, 0.95),
    ("free software", r"is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "lgpl", 2, 0.95),
    ("free software", r"is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e", "agpl", 2, 0.95),
    ("any later version", r"either version 2 of the licen[cs]e,? or \(at your option\) any later version", "gpl-2.0", 3, 0.85),
    ("any later version", r"either version 3 of the licen[cs]e,? or \(at your option\) any later version", "gpl-3.0", 3, 0.85),
    ("any later version", r"either version 2\.1 of the licen[cs]e,? or \(at your option\) any later version", "lgpl-2.1", 3, 0.85),
    ("it will be useful", r"is distributed in the hope that it will be useful, but without any warranty", "gpl", 3, 0.85),
    ("implied warranty of merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose", "gpl", 3, 0.8),
    ("you should have received a copy", r"you should have received a copy of the gnu general public licen[cs]e", "gpl", 2, 0.9),
    ("you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "lgpl", 2, 0.9),
    ("you should have received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e", "agpl", 2, 0.9),
    ("verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", "gpl", 4, 0.8),
    ("freedom to share and change", r"the licenses for most software are designed to take away your freedom to share and change it", "gpl-2.0", 2, 0.95),
    ("copyleft license for software", r"the gnu general public license is a free, copyleft license for software and other kinds of works", "gpl-3.0", 2, 0.95),
    ("copyleft license for software", r"the gnu affero general public license is a free, copyleft license for software", "agpl-3.0", 2, 0.95),
    ("remotely through a computer network", r"interact(?:ing)? with (?:it|users) remotely through a computer network", "agpl-3.0", 3, 0.85),
    ("special exception", r"as a special exception, (?:the copyright holders?|you may|if you|the free software foundation)[^\n]{0,80}", "gpl-exception", 4, 0.8),
    ("invariant sections", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts", "gfdl", 2, 0.95),
    ("free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e", "gfdl", 2, 0.95),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("source code form is subject", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0", "mpl-2.0", 2, 1.0),
    ("copy of the mpl", r"if a copy of the mpl was not distributed with this file", "mpl-2.0", 2, 0.95),
    ("contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1\.1", "mpl-1.1", 2, 1.0),
    ("contents of this file are subject", r"the contents of this file are subject to the netscape public license", "npl", 2, 0.95),
    ("contents of this file are subject", r"the contents of this file are subject to the terms of the common development and distribution license", "cddl", 2, 1.0),
    ("contents of this file are subject", r"the contents of this file are subject to the sun public license", "spl", 2, 0.95),
    ("contents of this file are subject", r"the contents of this file are subject to the interbase public license", "interbase", 2, 0.95),
    ("accompanying materials", r"this program and the accompanying materials are (?:made available|licensed) under the terms (?:and conditions )?of the eclipse public license", "epl", 2, 1.0),
    ("accompanying program", r"the accompanying program is provided under the terms of this (?:eclipse|common) public license", "epl", 3, 0.9),
    ("q public licen", r"\bq public licen[cs]e\b", "qpl", 4, 0.85),
    ("latex project public licen", r"\blatex project public licen[cs]e\b", "lppl", 4, 0.9),
    ("cecill", r"\bcecill(?:-b|-c)?(?: free software licen[cs]e agreement)?\b", "cecill", 4, 0.85),
    ("apple public source licen", r"\bapple public source licen[cs]e\b", "apsl", 4, 0.9),
    ("sun public licen", r"\bsun public licen[cs]e\b", "spl", 4, 0.85),
    ("netscape public licen", r"\bnetscape public licen[cs]e\b", "npl", 4, 0.85),
    ("reciprocal public licen", r"\breciprocal public licen[cs]e\b", "rpl", 4, 0.85),
    ("zope public licen", r"\bzope public licen[cs]e\b", "zpl", 4, 0.9),
    ("sleepycat licen", r"\bsleepycat licen[cs]e\b", "sleepycat", 4, 0.9),
    ("motosoto", r"\bmotosoto open source licen[cs]e\b", "motosoto", 4, 0.9),
    ("nokia open source licen", r"\bnokia open source licen[cs]e\b", "nokia", 4, 0.9),
    ("intel open source licen", r"\bintel open source licen[cs]e\b", "intel", 4, 0.9),
    ("nasa open source agreement", r"\bnasa open source agreement\b", "nasa", 4, 0.9),
    ("mulan permissive", r"\bmulan permissive software licen[cs]e\b", "mulanpsl", 4, 0.9),
    ("blue oak model licen", r"\bblue oak model licen[cs]e\b", "blueoak-1.0.0", 4, 0.9),
    ("w3c software", r"\bw3c software (?:and document )?notice and licen[cs]e\b", "w3c", 4, 0.9),
    ("open publication licen", r"\bopen publication licen[cs]e\b", "opubl", 4, 0.9),
    # Small and permissive
    ("express or implied warranty", r"this software is provided 'as-is', without any express or implied warranty", "zlib", 2, 0.95),
    ("must not be misrepresented", r"the origin of this software must not be misrepresented", "zlib", 2, 0.95),
    ("altered source versions", r"altered source versions must be plainly marked as such", "zlib", 2, 0.95),
    ("person or organization obtaining", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0", 2, 0.95),
    ("free and unencumbered software", r"this is free and unencumbered software released into the public domain", "unlicense", 2, 1.0),
    ("anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense", 2, 0.95),
    ("you want to public licen", r"do what the f\S+ you want to public licen[cs]e", "wtfpl", 2, 1.0),
    ("beer-ware", r"\"?the beer-ware licen[cs]e\"?", "beerware", 2, 0.95),
    ("buy me a beer", r"if we meet some ?day,? and you think this stuff is worth it,? you can buy me a beer", "beerware", 2, 0.95),
    ("charityware", r"\bvim is charityware\b", "vim", 2, 0.9),
    ("same terms as perl", r"under the same terms as perl(?: itself)?", "artistic-or-gpl", 2, 0.9),
    ("under which a package may be copied", r"the intent of this document is to state the conditions under which a package may be copied", "artistic-1.0", 2, 0.95),
    ("psf is making python available", r"psf is making python available to licensee on an \"?as is\"? basis", "psf-2.0", 2, 0.95),
    ("openssl project", r"this product includes software developed by the openssl project", "openssl", 2, 0.95),
    ("eric young", r"this product includes (?:cryptographic )?software written by eric young", "ssleay", 2, 0.95),
    ("may not be called", r"products derived from this software may not be called \"?php\"?", "php", 2, 0.95),
    ("independent jpeg group", r"this software is based in part on the work of the independent jpeg group", "ijg", 2, 0.95),
    ("freetype project", r"\b(?:the )?freetype project licen[cs]e\b", "ftl", 3, 0.9),
    ("png reference library", r"the png reference library is supplied \"?as is\"?", "libpng", 2, 0.95),
    ("unicode data files", r"to any person obtaining a copy of the unicode data files", "unicode", 2, 0.95),
    ("either the terms of the 2-clause", r"you can redistribute it and/or modify it under either the terms of the 2-clause bsdl", "ruby", 2, 0.95),
    ("postgresql global development group", r"portions copyright \(c\) [^\n]{1,40} the postgresql global development group", "postgresql", 3, 0.85),
    ("university of illinois", r"\buniversity of illinois(?:/ncsa)? open source licen[cs]e\b", "ncsa", 2, 0.95),
    # Fonts, data and models
    ("font software", r"this font software is licensed under the sil open font licen[cs]e", "ofl", 2, 1.0),
    ("font software", r"the font software may be modified, altered, or added to", "bitstream-vera", 2, 0.95),
    ("reserved font name", r"with reserved font names?\b", "ofl", 3, 0.85),
    ("open data commons", r"\bopen data commons attribution licen[cs]e\b", "odc-by", 3, 0.9),
    ("open data commons", r"\bopen data commons public domain dedication (?:and|&) licen[cs]e\b", "pddl", 3, 0.9),
    ("community data licen", r"\bcommunity data licen[cs]e agreement\b", "cdla", 3, 0.9),
    ("open government licen", r"\bopen government licen[cs]e\b", "ogl", 3, 0.9),
    ("licence ouverte", r"\blicence ouverte\b", "etalab", 3, 0.9),
    ("datenlizenz deutschland", r"\bdatenlizenz deutschland\b", "dl-de", 3, 0.9),
    ("openrail", r"\b(?:bigscience )?openrail(?:-m|\+\+)?(?: licen[cs]e)?\b", "openrail", 3, 0.9),
    ("responsible ai licen", r"\bresponsible ai licen[cs]es?\b", "openrail", 4, 0.85),
    ("community license agreement", r"\bllama [0-9.]+ community license agreement\b", "llama", 3, 0.9),
    # Creative Commons and the public domain
    ("creative commons", r"this (?:work|article|document|page|text|image|book) is licensed under (?:a|the) creative commons", "cc", 4, 0.85),
    ("some rights reserved", r"\bsome rights reserved\b", "cc", 6, 0.6),
    ("associated a work with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain", "cc0", 2, 1.0),
    ("extent possible under law", r"to the extent possible under law,? [^\n]{1,120} waived all copyright", "cc0", 2, 0.95),
    ("public domain", r"\b(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain\b", "public-domain", 3, 0.8),
    ("public domain", r"\bpublic domain (?:dedication|mark|notice)\b", "public-domain", 4, 0.7),
    ("no known copyright", r"\bno known copyright restrictions?\b", "public-domain", 4, 0.7),
    ("government", r"\bworks? of the (?:united states|u\.s\.) government\b", "us-government-work", 4, 0.7),
    # Source available and restricted
    ("commons clause", r"\bcommons clause(?: license condition)?\b", "commons-clause", 3, 0.9),
    ("right to sell the software", r"does not grant to you,? the right to sell the software", "commons-clause", 2, 0.95),
    ("polyform", r"\bpolyform (?:noncommercial|strict|small business|shield|perimeter|free trial|internal use) licen[cs]e\b", "polyform", 3, 0.9),
    ("change licen", r"\bchange licen[cs]e: ?(?:gpl|gnu|apache|mozilla)\b", "busl", 4, 0.7),
    ("hippocratic licen", r"\bhippocratic licen[cs]e\b", "hippocratic", 3, 0.9),
    ("parity public licen", r"\bparity public licen[cs]e\b", "parity", 3, 0.9),
    ("anti-996", r"\banti-996 licen[cs]e\b", "anti-996", 3, 0.9),
    ("end user licen", r"\bend user licen[cs]e agreement\b", "eula", 4, 0.8),
    ("end-user licen", r"\bend-user licen[cs]e agreement\b", "eula", 4, 0.8),
    ("reverse engineer", r"\b(?:may not|shall not|not to|agree not to) reverse engineer,? decompile,? or disassemble\b", "eula", 4, 0.8),
    ("reverse-engineer", r"\b(?:may not|shall not|not to|agree not to) reverse-engineer,? decompile,? or disassemble\b", "eula", 4, 0.8),
    ("you agree to be bound", r"\byou agree to be bound by the terms\b", "eula", 5, 0.6),
    # Notices
    ("all rights reserved", r"\ball rights reserved\b", "all-rights-reserved", 7, 0.5),
    ("proprietary", r"\b(?:confidential and proprietary|proprietary and confidential)\b", "proprietary", 4, 0.8),
    ("trade secret", r"\bcontains? trade secrets? (?:and|or|of|belonging)\b", "proprietary", 4, 0.8),
    ("confidential information", r"\bcontains? confidential information (?:and|or|of|belonging)\b", "proprietary", 4, 0.8),
    ("unauthori", r"\bunauthori[sz]ed (?:copying|reproduction|use|duplication|distribution|redistribution)\b", "proprietary", 5, 0.7),
    ("no part of this", r"\bno part of this (?:book|publication|work|document|website|material|software) may be (?:reproduced|copied|used|transmitted|distributed)\b", "no-reproduction", 4, 0.8),
    ("reproduction", r"\breproduction (?:in whole or in part |of this \w+ )?(?:is )?(?:strictly )?(?:prohibited|forbidden)\b", "no-reproduction", 4, 0.75),
    ("written permission", r"\bwithout (?:the )?(?:prior |express |specific )*written permission (?:of|from)\b", "permission-required", 6, 0.6),
    ("written consent", r"\bwithout (?:the )?(?:prior |express |specific )*written consent (?:of|from)\b", "permission-required", 6, 0.6),
    ("permission", r"\b(?:used|reprinted|reproduced|republished) (?:with|by) (?:kind )?permission\b", "by-permission", 6, 0.6),
    ("internal use only", r"\bfor internal use only\b", "internal", 4, 0.7),
    ("use only", r"\bfor (?:your )?personal(?:,? non-?commercial)? use only\b", "non-commercial", 4, 0.7),
    ("not for resale", r"\bnot for resale\b", "no-resale", 5, 0.6),
    ("evaluation purposes only", r"\bfor evaluation purposes only\b", "evaluation", 4, 0.7),
    ("educational", r"\bfor (?:non-?profit )?educational (?:use|purposes) only\b", "non-commercial", 4, 0.7),
    ("research purposes only", r"\bfor (?:academic |non-?commercial )?research purposes only\b", "non-commercial", 4, 0.7),
    ("commercial use", r"\b(?:for )?non-?commercial use only\b", "non-commercial", 4, 0.7),
    ("commercial use", r"\b(?:no|not for) commercial use\b", "non-commercial", 4, 0.7),
    ("commercial purposes", r"\b(?:may|shall|must) not be (?:used|reproduced|distributed|copied) for commercial purposes\b", "non-commercial", 4, 0.7),
    ("redistribut", r"\b(?:no|not) (?:be )?redistribut(?:ed|ion)\b", "no-redistribution", 5, 0.6),
    ("data mining", r"\bdata mining (?:is |are )?(?:not permitted|prohibited|forbidden|reserved)\b", "no-mining", 4, 0.8),
    ("machine learning training", r"\bmachine learning training (?:is |are )?(?:not permitted|prohibited|forbidden|reserved)\b", "no-mining", 4, 0.8),
    # Links to license texts
    ("creativecommons.org/licenses/by", r"creativecommons\.org/licenses/by/", "cc-by", 6, 0.9),
    ("creativecommons.org/licenses/by-sa", r"creativecommons\.org/licenses/by-sa/", "cc-by-sa", 6, 0.9),
    ("creativecommons.org/licenses/by-nd", r"creativecommons\.org/licenses/by-nd/", "cc-by-nd", 6, 0.9),
    ("creativecommons.org/licenses/by-nc", r"creativecommons\.org/licenses/by-nc/", "cc-by-nc", 6, 0.9),
    ("creativecommons.org/licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/", "cc-by-nc-sa", 6, 0.9),
    ("creativecommons.org/licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/", "cc-by-nc-nd", 6, 0.9),
    ("creativecommons.org/publicdomain/zero", r"creativecommons\.org/publicdomain/zero/", "cc0", 6, 0.9),
    ("creativecommons.org/publicdomain/mark", r"creativecommons\.org/publicdomain/mark/", "public-domain", 6, 0.9),
    ("opensource.org/licenses/mit", r"opensource\.org/licenses/mit\b", "mit", 6, 0.9),
    ("opensource.org/licenses/bsd", r"opensource\.org/licenses/bsd-3-clause\b", "bsd-3-clause", 6, 0.9),
    ("opensource.org/licenses/bsd", r"opensource\.org/licenses/bsd-2-clause\b", "bsd-2-clause", 6, 0.9),
    ("opensource.org/licenses/isc", r"opensource\.org/licenses/isc\b", "isc", 6, 0.9),
    ("apache.org/licenses", r"apache\.org/licenses/license-2\.0", "apache-2.0", 6, 0.9),
    ("gnu.org/licenses", r"gnu\.org/licenses/(?:gpl|old-licenses/gpl)", "gpl", 6, 0.9),
    ("gnu.org/licenses", r"gnu\.org/licenses/(?:lgpl|old-licenses/lgpl)", "lgpl", 6, 0.9),
    ("gnu.org/licenses", r"gnu\.org/licenses/agpl", "agpl", 6, 0.9),
    ("gnu.org/", r"gnu\.org/(?:licenses/fdl|copyleft/fdl)", "gfdl", 6, 0.9),
    ("mozilla.org/mpl", r"mozilla\.org/mpl/2\.0", "mpl-2.0", 6, 0.9),
    ("eclipse.org/legal/epl", r"eclipse\.org/legal/epl-(?:v10|2\.0)", "epl", 6, 0.9),
    ("boost.org/license", r"boost\.org/license_1_0\.txt", "bsl-1.0", 6, 0.9),
    ("unlicense.org", r"\bunlicense\.org\b", "unlicense", 6, 0.9),
    ("scripts.sil.org/ofl", r"scripts\.sil\.org/ofl", "ofl", 6, 0.9),
)
