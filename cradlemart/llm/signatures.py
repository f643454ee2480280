"""Hand-written signatures of license texts, notices, file headers, addresses and short tags.

Each is a label, a confidence, and patterns over words: lower case, joined by one blank, without
punctuation ("Apache-2.0" is "apache 2 0"). A pattern has no open repetition and no group in a group.
"""

from __future__ import annotations

SIGNATURES = (
    # Grants, conditions and disclaimers as they stand in the licenses.
    ("mit", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0.95, "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 0.9, "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", 0.95, "name of the x consortium shall not be used in advertising or otherwise to promote"),
    ("hpnd", 0.85, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd-sell", 0.9, "permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    ("postgresql", 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("isc", 1.0, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", 0.95, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", 0.95, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 0.85, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 0.85, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 0.8, "provided by the (?:copyright holders|regents|author) and contributors as is and any express or implied warranties"),
    ("bsd-3-clause", 0.95, "names? of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 1.0, "advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", 0.95, "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("apache-2.0", 0.8, "may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 0.8, "terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache-2.0", 0.9, "grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants"),
    ("apache-2.0", 0.9, "grant of copyright licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants"),
    ("apache-1.1", 0.85, "product includes software developed by the apache software foundation"),
    ("apache-2.0", 0.7, "product includes software developed at the apache software foundation"),
    ("gpl", 0.85, "program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", 0.85, "library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 0.95, "program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 0.95, "library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 0.95, "redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl-2.0", 0.85, "either version 2 of the licen[sc]e or(?: at your option)? any later version"),
    ("gpl-3.0", 0.85, "either version 3 of the licen[sc]e or(?: at your option)? any later version"),
    ("lgpl-2.1", 0.85, "either version 2 1 of the licen[sc]e or(?: at your option)? any later version"),
    ("gpl", 0.9, "should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", 0.9, "should have received a copy of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 0.9, "should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl", 0.9, "general public licen[sc]e does not permit incorporating your program into proprietary programs"),
    ("gpl-2.0", 0.9, "must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-3.0", 0.9, "may not impose any further restrictions on the exercise of the rights granted or affirmed under this licen[sc]e"),
    ("agpl-3.0", 0.95, "modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", 1.0, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("classpath-exception-2.0", 0.95, "linking this library statically or dynamically with other modules is making a combined work"),
    ("mpl-2.0", 1.0, "source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-2.0", 0.95, "copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", 0.8, "source code form that is incompatible with secondary licen[sc]es"),
    ("mpl-1.1", 1.0, "contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("epl", 0.95, "accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl-1.0", 0.9, "accompanying program is provided under the terms of this eclipse public licen[sc]e"),
    ("cddl", 0.95, "contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-1.0", 0.9, "accompanying program is provided under the terms of this common public licen[sc]e"),
    ("artistic-1.0-perl", 0.95, "under the same terms as perl(?: 5)? itself"),
    ("artistic", 0.9, "copyright holder maintains some semblance of artistic control over the development of the package"),
    ("zlib", 0.9, "without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", 0.95, "origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.95, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", 1.0, "free and unencumbered software released into the public domain"),
    ("unlicense", 0.95, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 1.0, "do what the fuck you want to public licen[sc]e"),
    ("wtfpl", 0.9, "you just do what the fuck you want to"),
    ("boost-1.0", 1.0, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1.0", 0.8, "derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("cc0-1.0", 0.95, "associated (?:a work with this deed|cc0 with this work) has dedicated the work to the public domain"),
    ("cc0-1.0", 0.9, "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("python-2.0", 0.95, "licen[sc]e agreement is between the python software foundation"),
    ("openssl", 0.9, "product includes software developed by the openssl project"),
    ("ssleay", 0.95, "package is an ssl implementation written by eric young"),
    ("ofl-1.1", 1.0, "font software is licen[sc]ed under the sil open font licen[sc]e"),
    ("ofl-1.1", 0.9, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ncsa", 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("json", 0.95, "software shall be used for good not evil"),
    ("beerware", 0.95, "long as you retain this notice you can do whatever you want with this stuff"),
    ("lppl", 0.95, "work may be distributed and or modified under the conditions of the latex project public licen[sc]e"),
    ("ijg", 0.9, "software is based in part on the work of the independent jpeg group"),
    ("unicode", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("upl-1.0", 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software associated documentation and or data"),
    ("w3c", 0.9, "permission to copy modify and distribute this (?:software|work) (?:and its documentation )?with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("sspl-1.0", 0.95, "make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", 0.95, "licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic-2.0", 0.9, "may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 0.95, "grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software"),
    ("bsd", 0.95, "use of this source code is governed by a bsd style licen[sc]e"),
    ("mit", 0.95, "use of this source code is governed by an mit style licen[sc]e"),
    ("fsf-all-permissive", 0.95, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    # Titles with their dates and notices that name more than one license.
    ("apache-2.0", 1.0, "apache licen[sc]e version 2 0 january 2004"),
    ("gpl-1.0", 1.0, "gnu general public licen[sc]e version 1 february 1989"),
    ("gpl-2.0", 1.0, "gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-3.0", 1.0, "gnu general public licen[sc]e version 3 29 june 2007"),
    ("lgpl-2.0", 1.0, "gnu library general public licen[sc]e version 2 june 1991"),
    ("lgpl-2.1", 1.0, "gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl-3.0", 1.0, "gnu lesser general public licen[sc]e version 3 29 june 2007"),
    ("agpl-3.0", 1.0, "gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("boost-1.0", 1.0, "boost software licen[sc]e version 1 0 august 17th 2003"),
    ("cddl-1.0", 1.0, "common development and distribution licen[sc]e cddl version 1 0"),
    ("mpl-2.0", 1.0, "mozilla public licen[sc]e version 2 0 1 definitions"),
    ("apache-2.0", 0.95, "licen[sc]ed under either of (?:the )?apache licen[sc]e version 2 0"),
    ("apache-2.0", 0.9, "apache licen[sc]e (?:version |v)?2 0 with llvm exceptions"),
    ("mit", 0.9, "(?:licen[sc]ed|released|distributed) under (?:the )?mit"),
    ("gfdl", 0.9, "gnu free documentation licen[sc]e"),
    # Addresses.
    ("apache-2.0", 1.0, "www apache org licenses license 2 0"),
    ("apache-1.1", 1.0, "www apache org licenses license 1 1"),
    ("gpl-2.0", 0.95, "www gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", 0.95, "www gnu org licenses gpl 3 0"),
    ("lgpl-2.1", 0.95, "www gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", 0.95, "www gnu org licenses lgpl 3 0"),
    ("agpl-3.0", 0.95, "www gnu org licenses agpl 3 0"),
    ("gpl", 0.6, "www gnu org licenses"),
    ("mpl-2.0", 0.95, "mozilla org mpl 2 0"),
    ("mpl-1.1", 0.95, "mozilla org mpl mpl 1 1"),
    ("epl-1.0", 0.95, "eclipse org legal epl v10"),
    ("epl-2.0", 0.95, "eclipse org legal epl (?:v20|2 0)"),
    ("boost-1.0", 0.95, "boost org license 1 0"),
    ("mit", 0.9, "opensource org licenses? mit"),
    ("bsd-3-clause", 0.9, "opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", 0.9, "opensource org licenses? bsd 2 clause"),
    ("isc", 0.9, "opensource org licenses? isc"),
    ("unlicense", 0.9, "unlicense org"),
    ("ofl-1.1", 0.9, "scripts sil org ofl"),
    ("odbl-1.0", 0.95, "opendatacommons org licenses odbl"),
    ("odc-by-1.0", 0.95, "opendatacommons org licenses by"),
    ("pddl-1.0", 0.95, "opendatacommons org licenses pddl"),
    ("cc0-1.0", 0.95, "creativecommons org publicdomain zero 1 0"),
    ("pdm-1.0", 0.95, "creativecommons org publicdomain mark 1 0"),
    ("cc-by-4.0", 0.95, "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 0.95, "creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", 0.95, "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 0.95, "creativecommons org licenses by sa 3 0"),
    ("cc-by-nd-4.0", 0.95, "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-4.0", 0.95, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", 0.95, "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 0.95, "creativecommons org licenses by nc nd 4 0"),
    # Short tags.
    ("mit", 0.8, "mit licen[sc]ed"),
    ("apache-2.0", 0.9, "apache 2(?: 0)? licen[sc]ed?"),
    ("gpl-2.0", 0.85, "(?:gnu )?gplv2"),
    ("gpl-2.0", 0.85, "gpl v2"),
    ("gpl-3.0", 0.85, "(?:gnu )?gplv3"),
    ("gpl-3.0", 0.85, "gpl v3"),
    ("lgpl-2.1", 0.85, "lgplv2 1"),
    ("lgpl-2.1", 0.85, "lgpl v2 1"),
    ("lgpl-3.0", 0.85, "lgplv3"),
    ("lgpl-3.0", 0.85, "lgpl v3"),
    ("agpl-3.0", 0.85, "agplv3(?: licen[sc]ed?)?"),
    ("agpl-3.0", 0.85, "agpl v3"),
    ("bsd-2-clause", 0.8, "bsd 2 clause"),
    ("bsd-2-clause", 0.8, "2 clause bsd"),
    ("bsd-3-clause", 0.8, "bsd 3 clause"),
    ("bsd-3-clause", 0.8, "3 clause bsd"),
    ("bsd-4-clause", 0.8, "4 clause bsd"),
    ("bsd-2-clause-patent", 0.85, "bsd 2 clause patent"),
    ("0bsd", 0.85, "(?:zero|0) clause bsd"),
    ("mpl-2.0", 0.8, "mplv2(?: 0)?"),
    ("mpl-2.0", 0.8, "mpl 2 0"),
    ("cddl-1.0", 0.8, "cddl (?:v)?1 0"),
    ("eupl-1.2", 0.85, "eupl (?:v )?1 2"),
    ("eupl-1.1", 0.85, "eupl (?:v )?1 1"),
    ("cc-by-sa", 0.7, "cc by sa"),
    ("cc-by-nd", 0.7, "cc by nd"),
    ("cc-by-nc", 0.7, "cc by nc"),
    ("cc-by-nc-sa", 0.75, "cc by nc sa"),
    ("cc-by-nc-nd", 0.75, "cc by nc nd"),
    # Further names.
    ("x11", 0.8, "x11 licen[sc]e"),
    ("ms-pl", 0.85, "microsoft public licen[sc]e"),
    ("ms-rl", 0.85, "microsoft reciprocal licen[sc]e"),
    ("afl-3.0", 0.85, "academic free licen[sc]e"),
    ("osl-3.0", 0.85, "open software licen[sc]e"),
    ("ecl-2.0", 0.85, "educational community licen[sc]e"),
    ("ncsa", 0.9, "university of illinois ncsa open source licen[sc]e"),
    ("beerware", 0.85, "beer ?ware licen[sc]e"),
    ("php-3.01", 0.85, "php licen[sc]e"),
    ("ruby", 0.8, "ruby licen[sc]e"),
    ("lppl", 0.85, "latex project public licen[sc]e"),
    ("cecill", 0.85, "cecill(?: b| c)? licen[sc]e"),
    ("ipl-1.0", 0.85, "ibm public licen[sc]e"),
    ("apsl-2.0", 0.85, "apple public source licen[sc]e"),
    ("upl-1.0", 0.85, "universal permissive licen[sc]e"),
    ("sspl-1.0", 0.85, "server side public licen[sc]e"),
    ("busl-1.1", 0.85, "business source licen[sc]e"),
    ("elastic-2.0", 0.85, "elastic licen[sc]e"),
    ("mulan-psl-2.0", 0.85, "mulan permissive software licen[sc]e"),
    ("blueoak-1.0", 0.85, "blue oak model licen[sc]e"),
    ("ogl-uk-3.0", 0.85, "open government licen[sc]e"),
    ("llama", 0.85, "llama (?:2 |3 )?community licen[sc]e"),
    ("proprietary", 0.85, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 0.85, "copyright holder reserves all rights not expressly granted"),
    ("proprietary", 0.8, "no part of this (?:publication|book|document) may be reproduced"),
)
