"""Signature rules for license texts, notices and references.

One rule a line: label, priority (0 to 100, also its confidence), keywords that must all occur (``+`` between them), pattern.
In a pattern a space stands for anything between two words; words are lower case. Gaps like ``.{0,40}`` count bytes.
"""

RULES = r"""
mit | 100 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 96 | mit+licen | (?:released|licensed|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit | 92 | mit+licen | under the mit licen[sc]e
mit | 90 | mit+licen | the mit licen[sc]e mit
mit | 88 | mit+licen | spdx license identifier mit
mit | 84 | mit+licen | mit licensed
mit | 80 | mit+licen | (?:the )?mit licen[sc]e
mit | 78 | mit+licen | licen[sc]e mit
mit | 74 | expat+licen | expat licen[sc]e
mit-0 | 95 | mit+attribution | mit no attribution(?: licen[sc]e)?
mit-0 | 93 | mit+licen | licen[sc]e(?: identifier)? mit 0
x11 | 92 | x11+licen | (?:mit )?x11 licen[sc]e
mit-modern | 90 | mit+modern | mit (?:licen[sc]e )?modern variant
apache-2 | 100 | apache+licen | licensed under the apache licen[sc]e version 2(?: 0)?
apache-2 | 98 | apache+licen | apache licen[sc]e version 2 0 january 2004
apache-2 | 96 | apache+licen | (?:released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | 92 | apache+licen | apache licen[sc]e version 2(?: 0)?
apache-2 | 90 | apache+licen | apache(?: software)? licen[sc]e (?:v|ver )?2(?: 0)?
apache-2 | 90 | apache 2 | spdx license identifier apache 2 0
apache-2 | 86 | apache 2 | apache 2 0 licensed?
apache-2 | 84 | apache+licen | apache 2(?: 0)? licen[sc]e
apache-2 | 82 | apache.org+licen | apache org licenses license 2 0
apache-1 | 95 | apache+licen | apache(?: software)? licen[sc]e version 1 [01]
apache-1 | 90 | apache 1 | spdx license identifier apache 1 [01]
apache | 60 | apache+licen | apache(?: software)? licen[sc]e
gpl-3 | 100 | general public licen | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3(?: or (?:at your option )?any later version)?
gpl-3 | 98 | general public licen | gnu general public licen[sc]e version 3 29 june 2007
gpl-3 | 94 | gpl | (?:gnu )?gpl ?v ?3(?: 0)?(?: only| or later)?
gpl-3 | 92 | gpl | (?:gnu )?gpl (?:version|ver) 3(?: 0)?
gpl-3 | 92 | gpl 3 | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 | 90 | gpl-3 | gpl 3(?: 0)?(?: only| or later)?
gpl-3 | 88 | licenses/gpl-3 | licenses gpl 3 0
gpl-2 | 100 | general public licen | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2(?: or (?:at your option )?any later version)?
gpl-2 | 98 | general public licen | gnu general public licen[sc]e version 2 june 1991
gpl-2 | 94 | gpl | (?:gnu )?gpl ?v ?2(?: 0)?(?: only| or later)?
gpl-2 | 92 | gpl | (?:gnu )?gpl (?:version|ver) 2(?: 0)?
gpl-2 | 92 | gpl 2 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 | 90 | gpl-2 | gpl 2(?: 0)?(?: only| or later)?
gpl-1 | 90 | general public licen | gnu general public licen[sc]e version 1
gpl-1 | 88 | gpl | spdx license identifier gpl 1 0
gpl | 80 | general public licen | gnu general public licen[sc]e
gpl | 70 | gpl | gnu gpl
gpl | 66 | gpl | gpl(?: licen[sc]e)?
gpl | 60 | general public licen | general public licen[sc]e
gpl-exception | 92 | gpl+classpath | gpl .{0,40}classpath exception
gpl-exception | 90 | special exception | as a special exception (?:the copyright holders|you may|if other files)
gpl-exception | 88 | runtime library exception | gcc runtime library exception
gpl-exception | 86 | font exception | gpl .{0,20}font exception
gpl-exception | 84 | linking exception | (?:gpl )?linking exception
lgpl-3 | 100 | lesser general public | gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3
lgpl-3 | 94 | lgpl | (?:gnu )?lgpl ?(?:v ?|version )?3(?: 0)?(?: only| or later)?
lgpl-2.1 | 100 | lesser general public | gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2 1
lgpl-2.1 | 94 | lgpl | (?:gnu )?lgpl ?(?:v ?|version )?2 1(?: only| or later)?
lgpl-2 | 98 | library general public | gnu library general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2
lgpl-2 | 90 | lgpl | (?:gnu )?lgpl ?(?:v ?|version )?2(?: 0)?(?: only| or later)?
lgpl | 82 | lesser general public | (?:gnu )?lesser general public licen[sc]e
lgpl | 80 | library general public | (?:gnu )?library general public licen[sc]e
lgpl | 70 | lgpl | (?:gnu )?lgpl
agpl-3 | 100 | affero general public | gnu affero general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3
agpl-3 | 94 | agpl | (?:gnu )?agpl ?(?:v ?|version )?3(?: 0)?(?: only| or later)?
agpl-1 | 94 | affero | affero general public licen[sc]e version 1
agpl | 82 | affero general public | (?:gnu )?affero general public licen[sc]e
agpl | 70 | agpl | (?:gnu )?agpl
gfdl-1.3 | 96 | free documentation | gnu free documentation licen[sc]e version 1 3
gfdl-1.2 | 96 | free documentation | gnu free documentation licen[sc]e version 1 2
gfdl-1.1 | 96 | free documentation | gnu free documentation licen[sc]e version 1 1
gfdl | 82 | free documentation | (?:gnu )?free documentation licen[sc]e
gfdl | 72 | gfdl | gfdl(?: 1 [123])?
bsd-3 | 100 | neither the name | neither the name of .{1,80}? nor the names of its contributors may be used to endorse
bsd-3 | 94 | bsd+clause | bsd 3 clause(?: new| revised| clear)?(?: licen[sc]e)?
bsd-3 | 92 | bsd+clause | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3 | 90 | bsd+licen | (?:new|modified|revised) bsd licen[sc]e
bsd-3 | 88 | bsd-3 | spdx license identifier bsd 3 clause
bsd-2 | 94 | bsd+clause | bsd 2 clause(?: simplified| freebsd)?(?: licen[sc]e)?
bsd-2 | 92 | bsd+clause | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2 | 90 | bsd+licen | (?:simplified|freebsd) (?:bsd )?licen[sc]e
bsd-4 | 96 | all advertising materials | all advertising materials mentioning features or use of this software must display
bsd-4 | 92 | bsd+clause | bsd 4 clause(?: licen[sc]e)?
bsd-4 | 90 | bsd+licen | (?:original|old) bsd licen[sc]e
bsd-1 | 90 | bsd+clause | bsd 1 clause(?: licen[sc]e)?
bsd-0 | 94 | 0bsd | (?:spdx license identifier )?0bsd(?: licen[sc]e)?
bsd-0 | 92 | bsd+clause | (?:bsd )?zero clause bsd(?: licen[sc]e)?
bsd | 86 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 76 | bsd+licen | under (?:the |a )?bsd (?:style )?licen[sc]e
bsd | 64 | bsd+licen | bsd (?:style )?licensed?
isc | 100 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 88 | isc+licen | (?:under )?(?:the )?isc licen[sc]e
isc | 86 | isc+identifier | spdx license identifier isc
mpl-2 | 100 | mozilla public licen | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-2 | 94 | source code form | this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-2 | 90 | mpl | mpl ?(?:v ?|version )?2(?: 0)?
mpl-1.1 | 98 | mozilla public licen | mozilla public licen[sc]e (?:version |v )?1 1
mpl-1.1 | 90 | mpl | mpl ?(?:v ?|version )?1 1
mpl-1 | 96 | mozilla public licen | mozilla public licen[sc]e (?:version |v )?1 0
mpl | 80 | mozilla public licen | mozilla public licen[sc]e
epl-2 | 98 | eclipse public licen | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-2 | 90 | epl | epl ?(?:v ?|version )?2(?: 0)?
epl-1 | 98 | eclipse public licen | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl-1 | 90 | epl | epl ?(?:v ?|version )?1(?: 0)?
epl | 80 | eclipse public licen | eclipse public licen[sc]e
edl-1 | 90 | eclipse distribution licen | eclipse distribution licen[sc]e(?: version 1 0| v 1 0| 1 0)?
cddl-1.1 | 96 | common development and distribution | common development and distribution licen[sc]e (?:version |v )?1 1
cddl-1 | 96 | common development and distribution | common development and distribution licen[sc]e (?:version |v )?1 0
cddl | 82 | common development and distribution | common development and distribution licen[sc]e
cddl | 74 | cddl | cddl(?: (?:version |v )?1 [01])?
cpl-1 | 88 | common public licen | common public licen[sc]e(?: version 1 0| v 1 0)?
ipl-1 | 88 | ibm public licen | ibm public licen[sc]e(?: version 1 0| v 1 0)?
eupl-1.2 | 96 | european union public | european union public licen[sc]e (?:version |v )?1 2
eupl-1.1 | 96 | european union public | european union public licen[sc]e (?:version |v )?1 1
eupl | 82 | european union public | european union public licen[sc]e
eupl | 74 | eupl | eupl(?: (?:version |v )?1 [012])?
osl-3 | 92 | open software licen | open software licen[sc]e (?:version |v )?3(?: 0)?
osl | 78 | open software licen | open software licen[sc]e
afl-3 | 92 | academic free licen | academic free licen[sc]e (?:version |v )?3(?: 0)?
afl | 78 | academic free licen | academic free licen[sc]e
artistic-2 | 94 | artistic licen | artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic-1 | 92 | artistic licen | artistic licen[sc]e (?:version |v )?1(?: 0)?
artistic | 78 | artistic licen | (?:perl )?artistic licen[sc]e
perl | 88 | same terms as perl | under the same terms as perl(?: itself)?
boost-1 | 96 | boost software licen | (?:distributed under the )?boost software licen[sc]e(?: version 1 0)?
boost-1 | 88 | bsl-1 | spdx license identifier bsl 1 0
business-source | 94 | business source licen | business source licen[sc]e(?: 1 1| version 1 1)?
sspl | 94 | server side public licen | server side public licen[sc]e(?: version 1| v 1)?
sspl | 84 | sspl | sspl(?: 1 0| v 1)?
elastic | 92 | elastic licen | elastic licen[sc]e(?: 2 0| version 2| v2)?
commons-clause | 92 | commons clause | commons clause(?: license condition)?
polyform | 90 | polyform | polyform (?:noncommercial|non commercial|small business|shield|strict|free trial|perimeter|internal use) licen[sc]e
zlib | 96 | without any express or implied warranty | provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 88 | zlib+licen | (?:under )?(?:the )?zlib (?:libpng )?licen[sc]e
libpng | 88 | libpng+licen | libpng licen[sc]e(?: version 2)?
unlicense | 100 | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | 86 | unlicen | (?:the )?unlicen[sc]e
wtfpl | 94 | do what the fuck you want | do what the fuck you want to public licen[sc]e
wtfpl | 84 | wtfpl | wtfpl(?: version 2| v2)?
beerware | 90 | beer | (?:the )?beer ?ware licen[sc]e
python-2 | 94 | python software foundation | python software foundation licen[sc]e(?: version 2)?
python-2 | 84 | psf | psf licen[sc]e(?: 2 0| version 2)?
php-3 | 92 | php licen | php licen[sc]e(?: version 3 0[01]?)?
ruby | 84 | ruby+licen | (?:the )?ruby licen[sc]e
ruby | 82 | same terms as ruby | under the same terms as ruby
ncsa | 90 | ncsa+licen | university of illinois ncsa open source licen[sc]e
ncsa | 80 | ncsa+licen | ncsa licen[sc]e
postgresql | 88 | postgresql+licen | postgresql licen[sc]e
openssl | 88 | openssl+licen | openssl licen[sc]e
ssleay | 84 | ssleay+licen | (?:original )?ssleay licen[sc]e
w3c | 88 | w3c+licen | w3c (?:software )?(?:notice and )?licen[sc]e
vim | 84 | vim+licen | vim licen[sc]e
curl | 84 | curl+licen | curl licen[sc]e
icu | 84 | icu+licen | icu licen[sc]e
unicode | 88 | unicode+licen | unicode (?:data files and software )?licen[sc]e(?: v3| agreement)?
ms-pl | 92 | microsoft public licen | microsoft public licen[sc]e
ms-pl | 80 | ms-pl | ms pl
ms-rl | 92 | microsoft reciprocal licen | microsoft reciprocal licen[sc]e
ms-rl | 80 | ms-rl | ms rl
mulan-2 | 90 | mulan | mulan (?:permissive software licen[sc]e|psl) v(?:ersion )?2
cecill-2.1 | 90 | cecill | cecill (?:free software licen[sc]e agreement )?(?:version )?2 1
cecill-b | 90 | cecill-b | cecill b
cecill-c | 90 | cecill-c | cecill c
cecill | 78 | cecill | cecill(?: licen[sc]e)?
ofl-1.1 | 96 | open font licen | (?:sil )?open font licen[sc]e (?:version |v )?1 1
ofl | 84 | open font licen | (?:sil )?open font licen[sc]e
ofl | 74 | ofl | ofl 1 [01]
upl-1 | 90 | universal permissive licen | universal permissive licen[sc]e(?: version 1 0| v 1 0)?
ecl-2 | 90 | educational community licen | educational community licen[sc]e(?: version 2 0| v 2 0)?
rpl | 88 | reciprocal public licen | reciprocal public licen[sc]e(?: (?:version )?1 [15])?
qpl-1 | 88 | q public licen | (?:the )?q public licen[sc]e(?: version 1 0)?
sleepycat | 88 | sleepycat+licen | sleepycat (?:software )?licen[sc]e
oracle | 70 | oracle+licen | oracle (?:technology network|binary code|free use) licen[sc]e
apsl-2 | 88 | apple public source | apple public source licen[sc]e(?: version 2 0| v 2 0)?
npl | 84 | netscape public licen | netscape public licen[sc]e(?: version 1 [01])?
sissl | 84 | sun industry standards | sun industry standards source licen[sc]e
spl | 82 | sun public licen | sun public licen[sc]e
nasa | 86 | nasa open source | nasa open source agreement(?: (?:version )?1 3)?
json | 90 | good not evil | (?:the )?software shall be used for good not evil
hippocratic | 86 | hippocratic licen | hippocratic licen[sc]e(?: (?:version )?[123] [01])?
openrail | 90 | rail+open | (?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?
llama | 86 | llama+licen | llama [23](?: [123])? community licen[sc]e
gemma | 84 | gemma+terms | gemma terms of use
cc0 | 100 | cc0 | (?:cc0 1 0 )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 | 90 | public domain dedication | (?:creative commons )?public domain dedication
cc-pdm | 90 | public domain mark | public domain mark(?: 1 0)?
cc-by-nc-nd | 98 | noncommercial+deriv | attribution noncommercial no ?deriv(?:ative)?s?
cc-by-nc-nd | 97 | non+commercial+deriv | attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-nd | 96 | cc+nc+nd | cc by nc nd(?: [1234] 0)?
cc-by-nc-nd | 92 | by-nc-nd | licenses by nc nd
cc-by-nc-sa | 98 | commercial+share | attribution non ?commercial share ?alike
cc-by-nc-sa | 96 | cc+nc+sa | cc by nc sa(?: [1234] 0)?
cc-by-nc-sa | 92 | by-nc-sa | licenses by nc sa
cc-by-nc | 95 | cc+nc | cc by nc(?: [1234] 0)?
cc-by-nc | 94 | commercial+attribution | (?:creative commons )?attribution non ?commercial
cc-by-nc | 92 | by-nc | licenses by nc
cc-by-nd | 94 | attribution+deriv | attribution no ?deriv(?:ative)?s?
cc-by-nd | 94 | cc+nd | cc by nd(?: [1234] 0)?
cc-by-nd | 92 | by-nd | licenses by nd
cc-by-sa | 94 | attribution+share | attribution share ?alike
cc-by-sa | 94 | cc+sa | cc by sa(?: [1234] 0)?
cc-by-sa | 92 | by-sa | licenses by sa
cc-by | 90 | creative commons attribution | creative commons attribution(?: (?:[1234] 0 )?(?:international|unported|generic))?(?: licen[sc]e)?
cc-by | 88 | cc by | cc by(?: [1234] 0)?
cc-by | 86 | cc-by | cc by(?: [1234] 0)?
cc-by | 84 | licenses/by/ | creativecommons org licenses by
cc-sampling | 84 | sampling plus | creative commons sampling plus(?: 1 0)?
cc | 66 | creative commons | (?:a )?creative commons licen[sc]e
cc | 60 | creativecommons.org | creativecommons org
odbl | 94 | open database licen | (?:open data commons )?open database licen[sc]e
odbl | 84 | odbl | odbl(?: 1 0| v1 0)?
odc-by | 92 | open data commons attribution | open data commons attribution licen[sc]e
odc-by | 84 | odc-by | odc by(?: 1 0)?
pddl | 92 | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[sc]e
pddl | 82 | pddl | pddl(?: 1 0)?
cdla-permissive | 90 | community data license | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 90 | community data license | community data license agreement sharing(?: version)?(?: 1 0)?
ogl-uk | 90 | open government licen | open government licen[sc]e(?: v3 0| v2 0| v1 0)?
etalab | 86 | licence ouverte | licence ouverte(?: (?:open licence )?(?:version )?[12] 0)?
dl-de | 86 | datenlizenz deutschland | datenlizenz deutschland (?:namensnennung|zero|null)(?: version)?(?: 2 0)?
public-domain | 80 | public domain | (?:released|placed|dedicated|put|is) (?:in|into|to) the public domain
public-domain | 70 | public domain | (?:in )?the public domain
proprietary | 86 | all rights reserved | all rights reserved
proprietary | 84 | proprietary and confidential | proprietary and confidential
proprietary | 82 | unauthorized | unauthorized (?:copying|use|reproduction|distribution) (?:of|or) .{1,60}? (?:strictly )?prohibited
proprietary | 80 | trade secret | (?:contains|contain) (?:the )?trade secrets? of
proprietary | 78 | end user licen | end user licen[sc]e agreement
proprietary | 76 | proprietary licen | proprietary licen[sc]e
proprietary | 72 | not for distribution | (?:internal use only )?not for distribution
proprietary | 70 | may not be reproduced | may not be reproduced(?: or (?:distributed|transmitted))?
proprietary | 68 | commercial licen | commercial licen[sc]e (?:agreement|terms|is required|required)
copyright | 56 | copyright | copyright(?: c)?(?: by)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 54 | copyright | (?:19|20)[0-9]{2} copyright
copyright | 52 | copyright holder | (?:the )?copyright holders?(?: and contributors)?
warranty | 50 | without warrant | without warranty of any kind(?: express or implied)?
warranty | 48 | provided+as is | (?:is )?provided (?:by .{1,60}? )?as is
warranty | 46 | merchantability | (?:implied )?warranties of merchantability
notice | 44 | licen | licensed under (?:the )?(?:following )?(?:terms|conditions|licen[sc]es?)
notice | 42 | licen | see (?:the )?(?:accompanying |included )?licen[sc]e(?: file| txt| md)?(?: for (?:more |further )?(?:details|information))
notice | 40 | free+software | this (?:work|file|program|library|software|project|material|content|article) is free software
notice | 40 | licensed | this (?:work|file|program|library|software|project|material|content|article) is licensed
notice | 40 | distributed | this (?:work|file|program|library|software|project|material|content|article) is distributed
notice | 38 | license identifier | spdx license identifier [0-9a-z]+(?: [0-9a-z]+){0,3}
dual | 36 | dual+licen | dual licensed(?: under)?
"""
