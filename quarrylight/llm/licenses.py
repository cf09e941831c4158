"""License scans with ordered signature rules.

Rules are hand-written regexes over normalised words. A rule runs only if its keyword occurs in the text. Detections that
lie within another of equal or higher priority are suppressed. Base phrases are found beside the rules in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.common import read_table, text_slices

# The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Hand-written rules: label, keyword that must occur, priority, regex over words joined by one space.
RULES = (
    # GNU
    ("gpl-3.0-only", "gpl 3 0 only", 92, r"gpl 3 0 only"),
    ("gpl-3.0-or-later", "gpl 3 0", 92, r"gpl 3 0 (?:or later|plus)"),
    ("gpl-2.0-only", "gpl 2 0 only", 92, r"gpl 2 0 only"),
    ("gpl-2.0-or-later", "gpl 2 0", 92, r"gpl 2 0 (?:or later|plus)"),
    ("gpl-3.0", "gpl 3", 80, r"(?:gnu )?gpl 3(?: 0)?"),
    ("gpl-2.0", "gpl 2", 80, r"(?:gnu )?gpl 2(?: 0)?"),
    ("gpl-1.0", "gpl 1", 80, r"(?:gnu )?gpl 1(?: 0)?"),
    ("gpl-3.0", "gplv3", 80, r"(?:gnu )?gplv3(?: licen[sc]e)?"),
    ("gpl-2.0", "gplv2", 80, r"(?:gnu )?gplv2(?: licen[sc]e)?"),
    ("gpl-3.0", "gpl v", 80, r"(?:gnu )?gpl v ?3(?: 0)?"),
    ("gpl-2.0", "gpl v", 80, r"(?:gnu )?gpl v ?2(?: 0)?"),
    ("gpl-3.0", "gpl version", 80, r"(?:gnu )?gpl version 3(?: 0)?"),
    ("gpl-2.0", "gpl version", 80, r"(?:gnu )?gpl version 2(?: 0)?"),
    ("gpl-3.0", "general public", 82, r"gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version |v )?3(?: 0)?"),
    ("gpl-2.0", "general public", 82, r"gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version |v )?2(?: 0)?"),
    ("gpl-1.0", "general public", 82, r"gnu general public licen[sc]e (?:v|version |v )?1(?: 0)?"),
    ("gpl-3.0-or-later", "general public", 86, r"gnu general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("gpl-2.0-or-later", "general public", 86, r"gnu general public licen[sc]e as published by the free software foundation either version 2 (?:of the licen[sc]e )?or (?:at your option )?any later version"),
    ("gpl-3.0", "general public", 82, r"version 3 of the gnu general public licen[sc]e"),
    ("gpl-2.0", "general public", 82, r"version 2 of the gnu general public licen[sc]e"),
    ("gpl", "general public", 60, r"gnu general public licen[sc]e"),
    ("gpl", "gpl", 55, r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: licen[sc]e)?(?! (?:v|version|[1-3]))"),
    ("gpl", "gpl", 50, r"(?:gnu )?gpl licen[sc]e"),
    ("gpl", "free software foundation", 50, r"as published by the free software foundation"),
    ("lgpl-3.0-only", "lgpl 3 0 only", 92, r"lgpl 3 0 only"),
    ("lgpl-3.0-or-later", "lgpl 3 0", 92, r"lgpl 3 0 or later"),
    ("lgpl-2.1-only", "lgpl 2 1 only", 92, r"lgpl 2 1 only"),
    ("lgpl-2.1-or-later", "lgpl 2 1", 92, r"lgpl 2 1 or later"),
    ("lgpl-3.0", "lgpl 3", 80, r"(?:gnu )?lgpl 3(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1", 80, r"(?:gnu )?lgpl 2 1"),
    ("lgpl-2.0", "lgpl 2", 78, r"(?:gnu )?lgpl 2(?: 0)?"),
    ("lgpl-3.0", "lgplv3", 80, r"(?:gnu )?lgplv3"),
    ("lgpl-2.1", "lgplv2", 80, r"(?:gnu )?lgplv2 1"),
    ("lgpl-3.0", "lgpl v", 80, r"(?:gnu )?lgpl v(?:ersion )? ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl v", 80, r"(?:gnu )?lgpl v(?:ersion )? ?2 1"),
    ("lgpl-3.0", "general public", 84, r"gnu lesser general public licen[sc]e (?:v|version |v )?3(?: 0)?"),
    ("lgpl-2.1", "general public", 84, r"gnu lesser general public licen[sc]e (?:v|version |v )?2 1"),
    ("lgpl-2.0", "general public", 84, r"gnu (?:lesser|library) general public licen[sc]e (?:v|version |v )?2(?: 0)?"),
    ("lgpl-3.0", "general public", 84, r"version 3 of the gnu lesser general public licen[sc]e"),
    ("lgpl-2.1", "general public", 84, r"version 2 1 of the gnu lesser general public licen[sc]e"),
    ("lgpl", "general public", 62, r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl", "lgpl", 50, r"(?:gnu )?lgpl(?: licen[sc]e)?"),
    ("agpl-3.0-only", "agpl 3 0 only", 92, r"agpl 3 0 only"),
    ("agpl-3.0-or-later", "agpl 3 0", 92, r"agpl 3 0 or later"),
    ("agpl-3.0", "agpl 3", 80, r"(?:gnu )?agpl 3(?: 0)?"),
    ("agpl-3.0", "agplv3", 80, r"(?:gnu )?agplv3"),
    ("agpl-3.0", "agpl v", 80, r"(?:gnu )?agpl v(?:ersion )? ?3(?: 0)?"),
    ("agpl-3.0", "affero", 84, r"(?:gnu )?affero general public licen[sc]e (?:v|version |v )?3(?: 0)?"),
    ("agpl-3.0", "affero", 84, r"version 3 of the (?:gnu )?affero general public licen[sc]e"),
    ("agpl-1.0", "affero", 84, r"affero general public licen[sc]e (?:v|version |v )?1(?: 0)?"),
    ("agpl", "affero", 62, r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", 50, r"(?:gnu )?agpl(?: licen[sc]e)?"),
    ("gfdl-1.3", "free documentation", 82, r"gnu free documentation licen[sc]e (?:v|version |v )?1 3"),
    ("gfdl-1.2", "free documentation", 82, r"gnu free documentation licen[sc]e (?:v|version |v )?1 2"),
    ("gfdl-1.1", "free documentation", 82, r"gnu free documentation licen[sc]e (?:v|version |v )?1 1"),
    ("gfdl", "free documentation", 62, r"gnu free documentation licen[sc]e"),
    ("gfdl-1.3", "gfdl 1 3", 85, r"gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.2", "gfdl 1 2", 85, r"gfdl 1 2(?: only| or later)?"),
    ("gfdl", "gfdl", 45, r"(?:gnu )?gfdl"),
    # Permissive
    ("mit", "mit", 60, r"(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[sc]e)?"),
    ("mit", "mit", 55, r"(?:the )?mit licen[sc]e"),
    ("mit", "mit", 75, r"spdx licen[sc]e identifier mit"),
    ("mit", "mit", 60, r"licen[sc]e mit"),
    ("mit", "mit", 60, r"mit expat licen[sc]e"),
    ("mit", "expat", 60, r"expat licen[sc]e"),
    ("mit", "permission is hereby", 85, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "without restriction", 70, r"to deal in the software without restriction including without limitation the rights"),
    ("mit-0", "mit 0", 82, r"(?:spdx licen[sc]e identifier mit 0|mit 0 licen[sc]e)"),
    ("mit-0", "no attribution", 80, r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", 60, r"x11 licen[sc]e"),
    ("apache-2.0", "apache 2", 82, r"(?:apache 2 0(?: licen[sc]e)?|apache 2 licen[sc]e)"),
    ("apache-2.0", "apache", 80, r"apache licen[sc]e (?:v|version |v )?2(?: 0)?"),
    ("apache-2.0", "apache", 82, r"apache software licen[sc]e (?:v|version |v )?2(?: 0)?"),
    ("apache-2.0", "asl 2", 80, r"asl 2 0"),
    ("apache-2.0", "apachev2", 80, r"apachev2"),
    ("apache-2.0", "version 2 0 of the apache", 82, r"version 2 0 of the apache licen[sc]e"),
    ("apache-1.1", "apache", 80, r"apache (?:software )?licen[sc]e (?:v|version |v )?1 1"),
    ("apache-1.0", "apache", 78, r"apache (?:software )?licen[sc]e (?:v|version |v )?1(?: 0)?"),
    ("apache-1.1", "apache 1 1", 82, r"apache 1 1"),
    ("apache", "apache", 55, r"apache (?:software )?licen[sc]e"),
    ("apache-2.0", "www apache org", 85, r"www apache org licenses license 2 0"),
    ("apache-2.0", "you may not use this file", 60, r"you may not use this file except in compliance with the licen[sc]e"),
    ("bsd-3-clause", "bsd 3", 82, r"bsd 3 clause(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd 2", 82, r"bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd 4", 82, r"bsd 4 clause(?: licen[sc]e)?"),
    ("0bsd", "0bsd", 82, r"0bsd"),
    ("0bsd", "zero clause", 80, r"zero clause bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "clause bsd", 80, r"(?:3|three) clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "clause bsd", 80, r"(?:2|two) clause bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", "clause bsd", 80, r"(?:4|four) clause bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", 80, r"(?:new|modified|revised) bsd licen[sc]e"),
    ("bsd-2-clause", "bsd", 80, r"(?:simplified|freebsd) bsd licen[sc]e"),
    ("bsd-2-clause", "freebsd", 78, r"freebsd licen[sc]e"),
    ("bsd-4-clause", "original bsd", 78, r"original bsd licen[sc]e"),
    ("bsd-3-clause", "bsd licen", 80, r"bsd licen[sc]e 3 clause"),
    ("bsd-2-clause", "bsd licen", 80, r"bsd licen[sc]e 2 clause"),
    ("bsd", "bsd", 58, r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?bsd(?: licen[sc]e)?(?! (?:licen[sc]e )?[2-4])"),
    ("bsd", "bsd", 55, r"bsd (?:style )?licen[sc]e"),
    ("bsd", "redistribution and use", 85, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", 82, r"neither the name of [a-z0-9 ]{1,80}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", 84, r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc", "isc", 55, r"isc licen[sc]e"),
    ("isc", "isc", 75, r"spdx licen[sc]e identifier isc"),
    ("isc", "permission to use", 85, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "zlib", 55, r"zlib(?: libpng)? licen[sc]e"),
    ("zlib", "zlib", 75, r"spdx licen[sc]e identifier zlib"),
    ("zlib", "without any express", 80, r"this software is provided as is without any express or implied warranty"),
    ("libpng", "libpng", 55, r"libpng licen[sc]e"),
    ("libpng", "png reference", 55, r"png reference library licen[sc]e"),
    ("boost-1.0", "bsl 1 0", 82, r"bsl 1 0"),
    ("boost-1.0", "boost", 80, r"boost software licen[sc]e (?:v|version |v )?1 0"),
    ("boost", "boost", 55, r"boost(?: software)? licen[sc]e"),
    ("unlicense", "unlicense", 55, r"(?:the )?unlicense"),
    ("unlicense", "free and unencumbered", 85, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", 70, r"wtfpl(?: (?:v|version |v )?[12])?"),
    ("wtfpl", "you want to", 75, r"do what the f[a-z]{3} you want to public licen[sc]e"),
    ("ncsa", "ncsa", 70, r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("ncsa", "ncsa", 75, r"spdx licen[sc]e identifier ncsa"),
    ("postgresql", "postgresql", 60, r"postgresql licen[sc]e"),
    ("python-2.0", "python", 75, r"python(?: software foundation)? licen[sc]e (?:v|version |v )?2(?: 0)?"),
    ("psf-2.0", "psf 2", 80, r"psf 2 0"),
    ("psf", "python software foundation", 65, r"python software foundation licen[sc]e(?: agreement)?"),
    ("psf", "psf", 50, r"psf licen[sc]e"),
    ("php-3.01", "php", 80, r"php licen[sc]e (?:v|version |v )?3 01"),
    ("php-3.0", "php", 78, r"php licen[sc]e (?:v|version |v )?3 0"),
    ("php-3.01", "php 3 01", 80, r"php 3 01"),
    ("php", "php", 55, r"php licen[sc]e"),
    ("ruby", "ruby", 55, r"ruby(?: s)? licen[sc]e"),
    ("ruby", "ruby", 75, r"spdx licen[sc]e identifier ruby"),
    ("vim", "vim", 55, r"vim licen[sc]e"),
    ("tcl", "tcl", 55, r"tcl(?: tk)? licen[sc]e"),
    ("curl", "curl", 55, r"curl licen[sc]e"),
    ("openssl", "openssl", 60, r"openssl licen[sc]e"),
    ("icu", "icu", 55, r"icu licen[sc]e"),
    ("unicode", "unicode licen", 55, r"unicode licen[sc]e"),
    ("unicode", "unicode inc", 70, r"unicode inc licen[sc]e agreement"),
    ("upl-1.0", "universal permissive", 80, r"universal permissive licen[sc]e(?: upl)?(?: (?:v|version |v )?1 0)?"),
    ("upl-1.0", "upl 1 0", 82, r"upl 1 0"),
    ("mulan-2.0", "mulanpsl 2", 82, r"mulanpsl 2 0"),
    ("mulan-2.0", "mulan", 80, r"mulan (?:permissive software licen[sc]e|psl) ?(?:v|version |v )?2"),
    ("mulan", "mulan", 60, r"mulan (?:permissive software licen[sc]e|psl)"),
    ("afl-3.0", "afl 3 0", 82, r"afl 3 0"),
    ("afl-3.0", "academic free", 80, r"academic free licen[sc]e (?:v|version |v )?3 0"),
    ("afl-2.1", "academic free", 80, r"academic free licen[sc]e (?:v|version |v )?2 1"),
    ("afl", "academic free", 60, r"academic free licen[sc]e"),
    ("artistic-2.0", "artistic 2", 82, r"artistic 2 0"),
    ("artistic-1.0", "artistic 1", 82, r"artistic 1 0"),
    ("artistic-2.0", "artistic", 80, r"artistic licen[sc]e (?:v|version |v )?2(?: 0)?"),
    ("artistic-1.0", "artistic", 80, r"artistic licen[sc]e (?:v|version |v )?1(?: 0)?"),
    ("artistic", "artistic", 55, r"(?:perl )?artistic licen[sc]e"),
    ("perl", "same terms as perl", 75, r"under the same terms as perl(?: itself)?"),
    ("beerware", "beer", 70, r"beer ?ware licen[sc]e"),
    ("blueoak-1.0", "blue oak", 80, r"blue oak model licen[sc]e(?: 1 0 0)?"),
    # Copyleft beyond GNU
    ("mpl-2.0", "mpl 2", 82, r"mpl 2 0"),
    ("mpl-1.1", "mpl 1", 82, r"mpl 1 1"),
    ("mpl-1.0", "mpl 1", 82, r"mpl 1 0"),
    ("mpl-2.0", "mozilla public", 80, r"mozilla public licen[sc]e (?:v|version |v )?2(?: 0)?"),
    ("mpl-1.1", "mozilla public", 82, r"mozilla public licen[sc]e (?:v|version |v )?1 1"),
    ("mpl-1.0", "mozilla public", 80, r"mozilla public licen[sc]e (?:v|version |v )?1(?: 0)?"),
    ("mpl", "mozilla public", 60, r"mozilla public licen[sc]e"),
    ("mpl-2.0", "mplv2", 80, r"mplv2(?: 0)?"),
    ("mpl-2.0", "subject to the terms of the mozilla", 85, r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("epl-2.0", "epl 2", 82, r"epl 2 0"),
    ("epl-1.0", "epl 1", 82, r"epl 1 0"),
    ("epl-2.0", "eclipse public", 80, r"eclipse public licen[sc]e (?:v|version |v )?2(?: 0)?"),
    ("epl-1.0", "eclipse public", 80, r"eclipse public licen[sc]e (?:v|version |v )?1(?: 0)?"),
    ("epl", "eclipse public", 60, r"eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse distribution", 80, r"eclipse distribution licen[sc]e(?: (?:v|version |v )?1 0)?"),
    ("cpl-1.0", "common public", 78, r"common public licen[sc]e(?: (?:v|version |v )?1 0)?"),
    ("ipl-1.0", "ibm public", 78, r"ibm public licen[sc]e(?: (?:v|version |v )?1 0)?"),
    ("cddl-1.0", "cddl 1", 82, r"cddl 1 0"),
    ("cddl-1.1", "cddl 1", 82, r"cddl 1 1"),
    ("cddl-1.0", "common development", 80, r"common development and distribution licen[sc]e(?: cddl)? (?:v|version |v )?1 0"),
    ("cddl-1.1", "common development", 80, r"common development and distribution licen[sc]e(?: cddl)? (?:v|version |v )?1 1"),
    ("cddl", "common development", 60, r"common development and distribution licen[sc]e"),
    ("cddl", "cddl", 45, r"cddl"),
    ("cpal-1.0", "common public attribution", 80, r"common public attribution licen[sc]e(?: (?:v|version |v )?1 0)?"),
    ("eupl-1.2", "eupl 1", 82, r"eupl 1 2"),
    ("eupl-1.1", "eupl 1", 82, r"eupl 1 1"),
    ("eupl-1.2", "european union public", 80, r"european union public licen[sc]e (?:eupl )?(?:v|version |v )?1 2"),
    ("eupl-1.1", "european union public", 80, r"european union public licen[sc]e (?:eupl )?(?:v|version |v )?1 1"),
    ("eupl", "european union public", 60, r"european union public licen[sc]e"),
    ("osl-3.0", "osl 3", 82, r"osl 3 0"),
    ("osl-3.0", "open software licen", 80, r"open software licen[sc]e (?:v|version |v )?3 0"),
    ("osl-2.1", "open software licen", 80, r"open software licen[sc]e (?:v|version |v )?2 1"),
    ("osl", "open software licen", 60, r"open software licen[sc]e"),
    ("qpl-1.0", "q public", 75, r"q public licen[sc]e(?: (?:v|version |v )?1 0)?"),
    ("rpl-1.5", "reciprocal public", 78, r"reciprocal public licen[sc]e(?: (?:v|version |v )?1 5)?"),
    ("cecill-2.1", "cecill", 80, r"cecill(?: free software licen[sc]e agreement)? (?:v|version |v )?2 1"),
    ("cecill-2.0", "cecill", 80, r"cecill(?: free software licen[sc]e agreement)? (?:v|version |v )?2(?: 0)?"),
    ("cecill-b", "cecill b", 80, r"cecill b"),
    ("cecill-c", "cecill c", 80, r"cecill c"),
    ("cecill", "cecill", 55, r"cecill"),
    ("ms-pl", "ms pl", 80, r"ms pl"),
    ("ms-pl", "microsoft public", 75, r"microsoft public licen[sc]e(?: ms pl)?"),
    ("ms-rl", "ms rl", 80, r"ms rl"),
    ("ms-rl", "microsoft reciprocal", 75, r"microsoft reciprocal licen[sc]e(?: ms rl)?"),
    ("sleepycat", "sleepycat", 60, r"sleepycat licen[sc]e"),
    ("sspl-1.0", "sspl 1", 82, r"sspl 1 0"),
    ("sspl-1.0", "server side public", 80, r"server side public licen[sc]e(?: (?:v|version |v )?1(?: 0)?)?"),
    ("busl-1.1", "busl 1", 82, r"busl 1 1"),
    ("busl-1.1", "business source", 80, r"business source licen[sc]e(?: (?:v|version |v )?1 1)?"),
    ("elastic-2.0", "elastic", 78, r"elastic licen[sc]e (?:v|version |v )?2 0"),
    ("elastic", "elastic", 55, r"elastic licen[sc]e"),
    ("commons-clause", "commons clause", 70, r"commons clause(?: licen[sc]e condition)?"),
    ("polyform-nc", "polyform", 78, r"polyform noncommercial licen[sc]e"),
    # Fonts, data, documents
    ("ofl-1.1", "ofl 1", 82, r"ofl 1 1"),
    ("ofl-1.1", "open font", 80, r"(?:sil )?open font licen[sc]e (?:v|version |v )?1 1"),
    ("ofl-1.0", "open font", 80, r"(?:sil )?open font licen[sc]e (?:v|version |v )?1 0"),
    ("ofl", "open font", 60, r"(?:sil )?open font licen[sc]e"),
    ("odbl-1.0", "odbl 1", 82, r"odbl 1 0"),
    ("odbl-1.0", "open database", 80, r"(?:odc )?open database licen[sc]e(?: odbl)? (?:v|version |v )?1 0"),
    ("odbl", "open database", 60, r"(?:odc )?open database licen[sc]e"),
    ("odc-by-1.0", "odc by", 82, r"odc by 1 0"),
    ("odc-by", "open data commons attribution", 75, r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "pddl", 82, r"pddl 1 0"),
    ("pddl", "public domain dedication", 75, r"open data commons public domain dedication and licen[sc]e"),
    ("cdla-permissive", "cdla", 80, r"cdla permissive [12] 0"),
    ("cdla-sharing", "cdla", 80, r"cdla sharing 1 0"),
    ("lppl-1.3", "latex project", 78, r"latex project public licen[sc]e(?: (?:v|version |v )?1 3c?)?"),
    ("ogl-uk-3.0", "open government", 78, r"open government licen[sc]e(?: (?:v|version |v )?3 0)?"),
    ("etalab-2.0", "licence ouverte", 75, r"(?:etalab )?licence ouverte(?: (?:v|version |v )?2 0)?"),
    ("etalab-2.0", "etalab", 75, r"etalab open licence(?: (?:v|version |v )?2 0)?"),
    ("dl-de-by-2.0", "datenlizenz", 78, r"datenlizenz deutschland namensnennung (?:version )?2 0"),
    # Creative Commons
    ("cc-by-nc-nd", "cc by", 90, r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", 90, r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", 80, r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", 80, r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", 80, r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", 70, r"cc by(?: [1-4] [05])?"),
    ("cc0-1.0", "cc0", 82, r"cc0 1 0(?: universal)?"),
    ("cc0", "cc0", 70, r"cc0"),
    ("cc0", "creative commons zero", 75, r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc0", "public domain dedication", 72, r"cc0 1 0 universal public domain dedication"),
    ("cc-by-nc-nd", "creative commons", 88, r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", 88, r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", 80, r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", 80, r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", 80, r"creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?"),
    ("cc-by", "creative commons", 68, r"creative commons attribution(?: [1-4] [05])?"),
    ("cc", "creative commons", 40, r"creative commons licen[sc]e"),
    ("cc-by-nc-nd", "creativecommons", 88, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 88, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 80, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 80, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 80, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by", "creativecommons", 75, r"creativecommons org licenses by [1-4] [05]"),
    ("cc0-1.0", "creativecommons", 82, r"creativecommons org publicdomain zero 1 0"),
    ("public-domain-mark", "creativecommons", 80, r"creativecommons org publicdomain mark 1 0"),
    # Models
    ("llama-2", "llama 2", 80, r"llama 2 community licen[sc]e(?: agreement)?"),
    ("llama-3", "llama 3", 80, r"(?:meta )?llama 3(?: [1-3])? community licen[sc]e(?: agreement)?"),
    ("llama-4", "llama 4", 80, r"llama 4 community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma", 70, r"gemma (?:terms of use|licen[sc]e)"),
    ("openrail", "openrail", 70, r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?"),
    ("openrail", "open rail", 70, r"(?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: licen[sc]e)?"),
    ("rail", "responsible ai", 70, r"(?:open )?responsible ai licen[sc]es?"),
    ("bigscience-bloom", "bigscience", 75, r"bigscience (?:bloom )?rail(?: licen[sc]e)?(?: (?:v|version |v )?1 0)?"),
    ("falcon", "falcon", 70, r"falcon(?: 180b)? tii licen[sc]e"),
    ("nc-research", "research purposes only", 60, r"for (?:non ?commercial )?research purposes only"),
    # Public domain, rights reserved, notices
    ("public-domain", "public domain", 50, r"(?:released|dedicated|placed|is|are) (?:in|to|into) the public domain"),
    ("public-domain", "public domain", 45, r"public domain software"),
    ("all-rights-reserved", "all rights reserved", 30, r"all rights reserved"),
    ("all-rights-reserved", "alle rechte", 30, r"alle rechte vorbehalten"),
    ("all-rights-reserved", "tous droits", 30, r"tous droits réservés"),
    ("all-rights-reserved", "todos los derechos", 30, r"todos los derechos reservados"),
    ("copyright", "copyright", 20, r"copyright (?:c |© )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("proprietary", "proprietary", 40, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized copying", 45, r"unauthorized copying of this (?:file|software|document)"),
    ("proprietary", "proprietary", 35, r"proprietary licen[sc]e"),
    ("proprietary", "commercial licen", 35, r"(?:requires|under) a commercial licen[sc]e"),
    ("non-commercial", "commercial use", 35, r"(?:not for|no|non) commercial use(?: only)?"),
    ("freeware", "freeware", 30, r"freeware licen[sc]e"),
    ("eula", "end user licen", 35, r"end user licen[sc]e agreement"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    pattern: re.Pattern[bytes]


def rules() -> list[Rule]:
    """Every rule, in order of falling priority, then as listed."""
    order = sorted(range(len(RULES)), key=lambda i: (-RULES[i][2], i))
    return [Rule(label, key, priority, re.compile(rb"(?<![^ ])(?:" + regex.encode() + rb")(?![^ ])")) for label, key, priority, regex in (RULES[i] for i in order)]


def suppressed(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Of (start, end, priority, label), those that lie in no other of higher priority, or of the same one and longer.

    In order of priority, then length, then place, a detection stays if no kept one contains it. A Fenwick tree over the
    starts holds the greatest kept end, so that a text with many detections costs n log n.
    """
    starts = {a: i + 1 for i, a in enumerate(sorted({x[0] for x in found}))}
    reach = [0] * (len(starts) + 1)
    kept: list[tuple[int, int, int, str]] = []
    for x in sorted(set(found), key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        i, best = starts[x[0]], 0
        while i:
            best = max(best, reach[i])
            i &= i - 1
        if best < x[1]:
            kept.append(x)
            i = starts[x[0]]
            while i < len(reach):
                reach[i] = max(reach[i], x[1])
                i += i & -i
    return sorted(kept)


class Scanner:
    """All rules behind one keyword automaton; most texts hold no keyword and cost one pass. Texts are normalised to words joined by one space."""

    def __init__(self) -> None:
        self.rules = rules()
        self.by_keyword: dict[str, list[Rule]] = {}
        for r in self.rules:
            self.by_keyword.setdefault(r.keyword, []).append(r)
        self.automaton = ahocorasick.Automaton()
        for key in self.by_keyword:
            self.automaton.add_word(key, key)
        self.automaton.make_automaton()
        self.base = [(b" " + p.encode() + b" ", label) for p, label in BASE]
        # A byte that is neither 0-9 nor a letter nor part of a character beyond ASCII separates words.
        self.table = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

    def words(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").translate(self.table).split()

    def scan(self, text: str) -> dict:
        words = self.words(text)
        joined = b" " + b" ".join(words) + b" "
        base = []
        for phrase, label in self.base:
            i = joined.find(phrase)
            while i >= 0:
                base.append((i, label))
                i = joined.find(phrase, i + 1)
        hit = {key for _, key in self.automaton.iter(joined.decode("latin-1"))}
        found = []
        for key in hit:
            for r in self.by_keyword[key]:
                found += [(m.start(), m.end(), r.priority, r.label) for m in r.pattern.finditer(joined)]
        found = suppressed(found)
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if base or found else None
        at = lambda i: int(np.searchsorted(spaces, i))  # noqa: E731  the word that begins after the space at i
        spans = [(at(a - 1), joined.count(b" ", a, b) + 1, label, p) for a, b, p, label in found]
        labels = {label for _, label in base} | {x[2] for x in spans}
        starts = [at(i) for i, _ in base]
        best = max([x[3] for x in spans] + [95 for _ in base], default=0)
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted({label for _, label in base})),
            "labels": ",".join(sorted(labels)),
            "score": min(1.0, best / 100),
            "spans": [{"start": s, "length": n, "label": label, "priority": p} for s, n, label, p in spans],
        }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,length:long,label:string,priority:int>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])))]
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, base phrases, labels, a score and the detected spans in words.

    A null or empty text has no words, no labels and score 0. Repeated rows give repeated rows. The score is the highest
    priority of a detection over 100 (0.95 at least with a base phrase). Other columns are ignored.
    """

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part, texts in text_slices(batches):
            rows = [scanner.scan(t) for t in texts]
            ids = part.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pylist([{"doc_id": i, **r} for i, r in zip(ids, rows, strict=True)], schema=_ARROW)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(scanned, SCHEMA)


def op5_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with base phrases and the labels of the rules."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
