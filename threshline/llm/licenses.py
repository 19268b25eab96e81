"""License scan: ordered signature rules, gated by keywords, resolved by containment and priority.

The text is lower-cased (A-Z) and reduced to its words, joined by single
spaces, so one rule covers any layout. A document that holds no gate keyword
is done after one pass of substring tests. For the others, only rules whose own
keyword occurs are evaluated. Detections are ordered by start, longest first;
one that lies within an earlier detection of the same or a higher priority is
suppressed. All of it is built-in column functions within the row, without a
shuffle.

Signatures of license texts and notices are written one by one (``SENTENCES``).
Besides, short statements that name a license are families: a template
(``STATED``) for each of the names (``NAMED``).

Cases: a null or empty text has no word and no label, and score 0; a null id
stays; repeated rows are judged alike; an empty table gives an empty result;
columns beyond id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshline.llm.common import blocks, let, running_sums

#: Base phrases and their labels (fixed values of the contract).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, keyword, and the words by which texts name the license (as a pattern over the reduced text).
NAMED = """
mit | mit | (?:the )?mit
mit-0 | mit | mit (?:no attribution|0)
isc | isc | (?:the )?isc
apache-1.1 | apache | apache(?: software)? (?:license )?(?:version |v )?1 1
apache-2 | apache | apache(?: software)?(?: license)?(?: version)? ?v?2(?: 0)?
bsd-2-clause | bsd | (?:the )?(?:(?:2|two) clause bsd|simplified bsd|bsd 2 clause|freebsd)
bsd-3-clause | bsd | (?:the )?(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd 3 clause)
bsd-4-clause | bsd | (?:the )?(?:(?:4|four) clause bsd|original bsd|bsd 4 clause)
gpl-1 | general public | gnu general public license(?: as published by the free software foundation)?(?: gpl)?(?: version| v)? 1
gpl-2 | general public | gnu general public license(?: as published by the free software foundation)?(?: gpl)?(?: either)?(?: version| v)? 2
gpl-3 | general public | gnu general public license(?: as published by the free software foundation)?(?: gpl)?(?: either)?(?: version| v)? 3
gpl-2 | gpl | (?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?
gpl-3 | gpl | (?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?
lgpl-2.1 | general public | gnu lesser general public license(?: lgpl)?(?: either)?(?: version| v)? 2 1
lgpl-3 | general public | gnu lesser general public license(?: lgpl)?(?: either)?(?: version| v)? 3
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?(?:version |v )?v?2 1
lgpl-3 | lgpl | (?:gnu )?lgpl ?(?:version |v )?v?3(?: 0)?
agpl-3 | general public | gnu affero general public license(?: agpl)?(?: version| v)? 3
agpl-3 | agpl | (?:gnu )?agpl ?(?:version |v )?v?3(?: 0)?
mpl-1.1 | mozilla | mozilla public license(?: mpl)?(?: version| v)? 1 1
mpl-2.0 | mozilla | mozilla public license(?: mpl)?(?: version| v)? 2(?: 0)?
epl-1.0 | eclipse | eclipse public license(?: epl)?(?: version| v)? 1(?: 0)?
epl-2.0 | eclipse | eclipse public license(?: epl)?(?: version| v)? 2(?: 0)?
cddl-1.0 | common development | common development and distribution license(?: cddl)?(?: version| v)? 1(?: 0)?
eupl-1.2 | european union | european union public licen[cs]e(?: eupl)?(?: version| v)? 1 2
artistic-2.0 | artistic | artistic license(?: version)? 2(?: 0)?
bsl-1.0 | boost | boost software license(?: version)?(?: 1 0)?
zlib | zlib | (?:the )?zlib(?: libpng)?
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | (?:the )?wtfpl
ofl-1.1 | open font | (?:sil )?open font license(?: ofl)?(?: version)?(?: 1 1)?
postgresql | postgresql | (?:the )?postgresql
python-2.0 | python software | python software foundation(?: license)?(?: version)?(?: 2)?
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc | cc by nc | cc by nc(?: [1-4] [05])?
cc-by-nd | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-sa | cc by sa | cc by sa(?: [1-4] [05])?
cc-by | cc by | cc by(?! n[cd]| sa)(?: [1-4] [05])?
cc-by-nc-nd | attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa | attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc | attribution | creative commons attribution non ?commercial
cc-by-nd | attribution | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | attribution | creative commons attribution share ?alike
cc-by | attribution | creative commons attribution(?! non| no| share)
"""

#: Priorities are 1 to this.
TIERS = 7
#: Kind of statement, priority, confidence, and the template around the name. A higher priority suppresses a lower one.
STATED = """
grant | 5 | 0.95 | (?:is |are )?(?:released|licensed|distributed|published|available|provided|offered|made available) under (?:the )?(?:terms of )?(?:the )?{name}(?: public)?(?: licen[cs]e)?
permission | 5 | 0.9 | (?:redistribute|modify|use|copy) (?:it|this software|and or modify it|them)? ?under (?:the )?terms of (?:the )?{name}(?: licen[cs]e)?
tag | 4 | 1.0 | spdx license identifier {name}
field | 4 | 0.85 | licen[cs]e {name}(?: licen[cs]e)?
subject | 3 | 0.8 | (?:subject to|governed by|covered by|in accordance with|compliance with) (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?
title | 2 | 0.7 | {name} (?:public )?licen[cs]e(?: version)?
"""

#: Signatures written by hand: label, priority, confidence, keyword, and a pattern over the reduced text (fixed values).
SENTENCES = """
mit | 6 | 0.95 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 5 | 0.85 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 5 | 0.8 | without restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit | 4 | 0.7 | arising from out of | whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings(?: in the software)?
mit-0 | 6 | 0.95 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | 6 | 0.9 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11-distribute | 5 | 0.85 | holders shall not be used | except as contained in this notice the names? of (?:the )?above copyright holders shall not be used in advertising
isc | 6 | 0.95 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 6 | 0.95 | permission to use | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | 7 | 0.95 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd | 6 | 0.85 | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
hpnd-sell | 6 | 0.85 | permission to use | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
ntp | 6 | 0.85 | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
postgresql | 6 | 0.95 | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
tcl | 6 | 0.9 | the authors hereby grant | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
icu | 6 | 0.85 | permission notice appear | provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation
curl | 6 | 0.85 | shall not be used in advertising | except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale
bsd-2-clause | 5 | 0.8 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | 4 | 0.7 | redistributions of source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 4 | 0.7 | redistributions in binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 6 | 0.95 | neither the name | neither the name of (?:[0-9a-z]+ ){1,8}nor the names of (?:its|any|their) contributors may be used to endorse
bsd-3-clause | 6 | 0.9 | endorse or promote | the names? of (?:its contributors|the authors?) may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause-clear | 7 | 0.9 | no express or implied licenses | no express or implied licenses to any party s patent rights are granted by this license
bsd-4-clause | 6 | 0.95 | advertising | all advertising materials mentioning features or use of this software must display
bsd-protection | 6 | 0.85 | bsd protection | bsd protection license
bsd-source-code | 5 | 0.8 | source code must retain | redistribution of source code must retain the above copyright notice
bsd-style | 2 | 0.6 | bsd style | (?:a |the )?bsd style licen[cs]e
bsd-style | 2 | 0.6 | governed by a bsd | use of this source code is governed by a bsd(?: style)? licen[cs]e
apache-1.0 | 6 | 0.85 | apache group | this product includes software developed by the apache group for use in the apache http server project
apache-1.1 | 6 | 0.9 | apache software foundation | this product includes software developed by the apache software foundation http www apache org
apache-2 | 6 | 0.95 | licensed under the apache | licensed under the apache license version 2(?: 0)?
apache-2 | 5 | 0.9 | except in compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2 | 5 | 0.9 | conditions of any kind | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2 | 6 | 0.9 | licensed to the apache | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | 5 | 0.85 | prominent notices | you must cause any modified files to carry prominent notices stating that you changed the files
gpl-1-or-later | 6 | 0.9 | version 1 or | gnu general public license as published by the free software foundation either version 1 or (?:at your option )?any later version
gpl-2-or-later | 6 | 0.95 | version 2 | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3-or-later | 6 | 0.95 | version 3 | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2-only | 6 | 0.9 | version 2 only | gnu general public license version 2 only
gpl-3-only | 6 | 0.9 | version 3 only | gnu general public license version 3 only
lgpl-2.1-or-later | 6 | 0.95 | version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3-or-later | 6 | 0.95 | version 3 | gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-2 | 6 | 0.9 | library general public | gnu library general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2
agpl-3-or-later | 6 | 0.95 | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl-1 | 6 | 0.9 | affero | affero general public license(?: version| v)? 1
gpl-family | 3 | 0.7 | without even the implied | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |library |affero )?general public license
gpl-family | 3 | 0.7 | you should have received | you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|software|file)
gpl-family | 2 | 0.6 | free software you can | is free software you can redistribute it and or modify it
gpl-2 | 5 | 0.85 | june 1991 | gnu general public license version 2 june 1991
gpl-3 | 5 | 0.85 | 29 june 2007 | gnu general public license version 3 29 june 2007
lgpl-2.1 | 5 | 0.85 | february 1999 | gnu lesser general public license version 2 1 february 1999
agpl-3 | 5 | 0.85 | 19 november 2007 | gnu affero general public license version 3 19 november 2007
gpl-classpath | 6 | 0.9 | special exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-gcc-exception | 6 | 0.9 | runtime library exception | gcc runtime library exception
gpl-autoconf | 6 | 0.85 | autoconf | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf
gfdl-1.1 | 6 | 0.9 | free documentation | gnu free documentation license(?: version)? 1 1
gfdl-1.2 | 6 | 0.9 | free documentation | gnu free documentation license(?: version)? 1 2
gfdl-1.3 | 6 | 0.9 | free documentation | gnu free documentation license(?: version)? 1 3
gfdl | 3 | 0.7 | free documentation | gnu free documentation license
gfdl-invariants | 5 | 0.8 | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-1.0 | 6 | 0.9 | mozilla public | subject to the mozilla public license version 1 0
mpl-1.1 | 6 | 0.95 | mozilla public | subject to the mozilla public license version 1 1
mpl-2.0 | 6 | 0.95 | this source code form | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-2.0-no-copyleft | 7 | 0.9 | incompatible with secondary | this source code form is incompatible with secondary licenses as defined by the mozilla public license
npl-1.1 | 6 | 0.9 | netscape public | netscape public license(?: version)? 1 1
epl-1.0 | 6 | 0.95 | eclipse public | made available under the terms of the eclipse public license v1 0
epl-2.0 | 6 | 0.95 | eclipse public | made available under the terms of the eclipse public license(?: v| version )?2 0
edl-1.0 | 6 | 0.9 | eclipse distribution | eclipse distribution license v(?:ersion )?1 0
cpl-1.0 | 6 | 0.9 | common public | common public license(?: version| v)? ?1 0
ipl-1.0 | 6 | 0.9 | ibm public | ibm public license(?: version)? 1 0
cddl-1.0 | 6 | 0.9 | common development | subject to the terms of the common development and distribution license
cddl-1.1 | 6 | 0.9 | common development | common development and distribution license cddl version 1 1
spl-1.0 | 6 | 0.85 | sun public | sun public license(?: version)? 1 0
sissl | 6 | 0.85 | sun industry | sun industry standards source license
oracle-bcl | 5 | 0.8 | oracle binary code | oracle binary code license agreement
upl-1.0 | 6 | 0.9 | universal permissive | (?:the )?universal permissive license(?: v| version )?1 0
apsl-2.0 | 6 | 0.9 | apple public source | apple public source license(?: version)? 2 0
apsl | 3 | 0.7 | apple public source | apple public source license
eupl-1.1 | 6 | 0.9 | european union | european union public licen[cs]e(?: eupl)?(?: version| v)? ?1 1
cecill-2.1 | 6 | 0.9 | cecill | (?:the )?cecill (?:free software )?license(?: agreement)?(?: version)? 2 1
cecill-b | 6 | 0.9 | cecill b | governed by the cecill b license under french law
cecill-c | 6 | 0.9 | cecill c | governed by the cecill c license under french law
cecill | 4 | 0.8 | cecill | governed by the cecill license under french law
artistic-1.0 | 6 | 0.9 | artistic licen | (?:the )?artistic license(?: version)? 1 0
artistic | 2 | 0.7 | artistic licen | terms of the artistic license
perl | 5 | 0.85 | same terms as perl | under the same terms as perl(?: itself)?
ruby | 5 | 0.85 | ruby s licen | under the terms of (?:the )?ruby s license
python-2.0 | 5 | 0.85 | psf licen | psf license agreement for python
cnri-python | 6 | 0.85 | cnri | cnri (?:open source )?license agreement
php-3.01 | 6 | 0.9 | php licen | version 3 01 of the php license
php-3.0 | 6 | 0.9 | php licen | version 3 0 of the php license
zpl-2.1 | 6 | 0.9 | zope public | zope public license(?: zpl)?(?: version)? 2 1
zpl-2.0 | 6 | 0.9 | zope public | zope public license(?: zpl)?(?: version)? 2 0
sleepycat | 6 | 0.85 | complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
openssl | 6 | 0.9 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 6 | 0.9 | cryptographic software | this product includes cryptographic software written by eric young
openldap-2.8 | 6 | 0.9 | openldap | (?:the )?openldap public license(?: version)? 2 8
zlib | 6 | 0.95 | provided as is without | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 5 | 0.85 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 5 | 0.85 | plainly marked | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng-2 | 6 | 0.85 | png reference library | png reference library (?:is supplied as is|license version 2)
ijg | 6 | 0.85 | independent jpeg | this software is based in part on the work of the independent jpeg group
libtiff | 6 | 0.85 | sam leffler | the names of sam leffler and silicon graphics may not be used in any advertising
bzip2-1.0.6 | 6 | 0.85 | libbzip2 | this program bzip2 the associated library libbzip2
info-zip | 6 | 0.85 | info zip | this is version [0-9a-z ]{3,24}of the info zip (?:copyright and )?license
freetype | 6 | 0.85 | freetype | portions of this software are copyright [0-9a-z ]{0,40}the freetype project
freetype | 5 | 0.85 | freetype project | (?:the )?freetype project license
unicode | 6 | 0.85 | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode-tou | 5 | 0.8 | unicode terms | unicode terms of use
w3c | 6 | 0.9 | w3c software | (?:the )?w3c software (?:and document )?(?:notice and )?license
w3c | 5 | 0.85 | provided by the copyright holders | this work is being provided by the copyright holders under the following license
ncsa | 6 | 0.9 | illinois | university of illinois ncsa open source license
ncsa | 5 | 0.85 | deal with the software | to deal with the software without restriction including without limitation
intel | 6 | 0.85 | intel open source | intel open source license
ms-pl | 6 | 0.9 | microsoft public | microsoft public license(?: ms pl)?
ms-rl | 6 | 0.9 | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
ms-lpl | 5 | 0.85 | microsoft limited | microsoft limited public license
osl-3.0 | 6 | 0.9 | open software licen | open software license(?: version| v)? ?3 0
afl-3.0 | 6 | 0.9 | academic free | academic free license(?: version| v)? ?3 0
afl-2.1 | 6 | 0.9 | academic free | academic free license(?: version| v)? ?2 1
ecl-2.0 | 6 | 0.9 | educational community | educational community license(?: version)? 2 0
rpl-1.5 | 6 | 0.9 | reciprocal public | reciprocal public license(?: version)? 1 5
nasa-1.3 | 6 | 0.9 | nasa open source | nasa open source agreement(?: version)? 1 3
qpl-1.0 | 6 | 0.9 | q public | (?:the )?q public license(?: version)?(?: 1 0)?
lppl-1.3c | 6 | 0.9 | latex project | latex project public license(?: version)? 1 3c?
lppl | 3 | 0.7 | latex project | latex project public license
vim | 6 | 0.85 | vim licen | (?:the )?vim license
beerware | 6 | 0.9 | beer ware | the beer ware license
beerware | 5 | 0.9 | buy me a beer | if we meet some day and you think this stuff is worth it you can buy me a beer
wtfpl | 6 | 0.95 | what the | do what the (?:fuck|f) you want to public license
unlicense | 6 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 5 | 0.85 | free to copy | anyone is free to copy modify publish use compile sell or distribute this software
json | 6 | 0.9 | not evil | the software shall be used for good not evil
bsl-1.0 | 6 | 0.95 | boost software | boost software license version 1 0
bsl-1.0 | 6 | 0.9 | machine executable object | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
fair | 6 | 0.85 | this instrument | usage of the works is permitted provided that this instrument is retained with the works
miros | 6 | 0.85 | provided that these terms | provided that these terms and disclaimer and all copyright notices are retained
naist-2003 | 6 | 0.85 | nara institute | copyright [0-9a-z ]{0,60}nara institute of science and technology
mulan-psl-2 | 6 | 0.9 | mulan | mulan (?:psl v2|permissive software license version 2)
blueoak-1.0.0 | 6 | 0.9 | blue oak | blue oak model license(?: version)?(?: 1 0 0)?
hippocratic | 6 | 0.85 | hippocratic | hippocratic license(?: version)?(?: [0-9] [0-9])?
anti-996 | 6 | 0.85 | anti 996 | anti 996 license
ofl-1.1 | 6 | 0.95 | open font | (?:this font software is )?licensed under the sil open font license(?: version)?(?: 1 1)?
ofl-1.1 | 5 | 0.85 | reserved font name | with reserved font names?
bitstream-vera | 6 | 0.9 | bitstream vera | bitstream vera is a trademark of bitstream inc permission is hereby granted
cc0-1.0 | 6 | 0.95 | waived all copyright | has waived all copyright and related or neighboring rights to this work
cc0-1.0 | 6 | 0.9 | public domain dedication | cc0 1 0 universal(?: cc0 1 0)? public domain dedication
cc-pdm | 5 | 0.85 | public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
cc-by-4.0 | 6 | 0.95 | attribution 4 0 | creative commons attribution 4 0 international(?: public)? license
cc-by-sa-4.0 | 6 | 0.95 | attribution share | creative commons attribution share ?alike 4 0 international(?: public)? license
cc-by-nc-4.0 | 6 | 0.95 | attribution non | creative commons attribution non ?commercial 4 0 international(?: public)? license
cc-by-nd-4.0 | 6 | 0.95 | attribution no | creative commons attribution no ?derivatives 4 0 international(?: public)? license
cc-by-3.0 | 6 | 0.9 | attribution 3 0 | creative commons attribution 3 0 (?:unported|united states)(?: public)? license
cc-by-sa-3.0 | 6 | 0.9 | attribution share | creative commons attribution share ?alike 3 0 (?:unported|united states)(?: public)? license
cc-by-2.0 | 6 | 0.9 | attribution 2 0 | creative commons attribution 2 0 (?:generic )?license
cc-legalcode | 3 | 0.7 | by exercising | by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons
odbl-1.0 | 6 | 0.9 | database licen | open (?:data commons open )?database license(?: odbl)?(?: v| version )?(?:1 0)?
odc-by-1.0 | 6 | 0.9 | open data commons | open data commons attribution license
pddl-1.0 | 6 | 0.9 | open data commons | open data commons public domain dedication and licen[cs]e
cdla-permissive-1.0 | 6 | 0.9 | community data licen | community data license agreement permissive(?: version)?(?: 1 0)?
cdla-sharing-1.0 | 6 | 0.9 | community data licen | community data license agreement sharing(?: version)?(?: 1 0)?
ogl-uk-3.0 | 6 | 0.9 | open government | licensed under the open government licence v3 0
ogl-uk | 3 | 0.8 | open government | open government licence
etalab-2.0 | 6 | 0.9 | licence ouverte | licence ouverte(?: open licence)?(?: version)? 2 0
sspl-1.0 | 6 | 0.9 | server side public | server side public license(?: version)?(?: 1)?
busl-1.1 | 6 | 0.9 | business source | business source license(?: version)? 1 1
elastic-2.0 | 6 | 0.9 | elastic licen | elastic license(?: version)? 2 0
commons-clause | 6 | 0.9 | commons clause | commons clause license condition(?: v1 0)?
commons-clause | 5 | 0.85 | right to sell | the license does not grant to you the right to sell the software
confluent-1.0 | 6 | 0.85 | confluent community | confluent community license(?: agreement)?(?: version)?(?: 1 0)?
polyform-noncommercial-1.0.0 | 6 | 0.9 | polyform | polyform noncommercial license(?: 1 0 0)?
polyform-small-business-1.0.0 | 6 | 0.9 | polyform | polyform small business license(?: 1 0 0)?
parity-7.0.0 | 6 | 0.85 | parity public | parity public license(?: 7 0 0)?
openrail-m | 6 | 0.85 | rail | (?:creativeml |bigscience )?open ?rail(?: m)? license
openrail-m | 5 | 0.8 | responsible ai | responsible ai license
llama-community | 6 | 0.85 | community licen | llama [0-9](?: [0-9])? community license agreement
gemma | 6 | 0.85 | gemma terms | gemma is provided under and subject to the gemma terms of use
fsf-all-permissive | 6 | 0.85 | copying and distribution | copying and distribution of this file with or without modification are permitted in any medium without royalty
fsf-unlimited | 6 | 0.85 | unlimited permission | this file is free software the free software foundation gives unlimited permission to copy and or distribute it
gnu-verbatim | 5 | 0.8 | verbatim copies | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
verbatim | 4 | 0.75 | verbatim copying | verbatim copying and distribution of this entire article is permitted
watcom-1.0 | 6 | 0.85 | sybase open watcom | sybase open watcom public license(?: version)? 1 0
nokia-1.0a | 6 | 0.85 | nokia open source | nokia open source license
rpsl-1.0 | 6 | 0.85 | realnetworks | realnetworks public source license
lpl-1.02 | 6 | 0.85 | lucent public | lucent public license(?: version)? 1 02
entessa | 6 | 0.8 | entessa | entessa public license
eiffel-2 | 6 | 0.8 | eiffel forum | eiffel forum license(?: version)? 2
frameworx | 6 | 0.8 | frameworx | frameworx open license
catosl-1.1 | 6 | 0.8 | computer associates | computer associates trusted open source license
cpal-1.0 | 6 | 0.85 | common public attribution | common public attribution license(?: version)? 1 0
cua-opl-1.0 | 6 | 0.8 | cua office | cua office public license
ngpl | 6 | 0.8 | nethack | nethack general public license
simpl-2.0 | 6 | 0.8 | simple public | simple public license(?: version)? 2 0
ssh-openssh | 5 | 0.8 | as far as i am concerned | as far as i am concerned the code i have written for this software can be used freely for any purpose
spencer | 5 | 0.8 | on any computer system | permission is granted to anyone to use this software for any purpose on any computer system
khronos | 5 | 0.8 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and or associated documentation files the materials
gpl-unversioned | 1 | 0.6 | general public | gnu general public license
lgpl-unversioned | 1 | 0.6 | general public | gnu lesser general public license
agpl-unversioned | 1 | 0.6 | general public | gnu affero general public license
mozilla-unversioned | 1 | 0.6 | mozilla public | mozilla public license
eclipse-unversioned | 1 | 0.6 | eclipse public | eclipse public license
dual | 2 | 0.6 | dual licen | dual licensed under
dual | 2 | 0.6 | alternatively | alternatively (?:the contents of )?this (?:file|software) may be (?:used|distributed) under the terms of
public-domain | 3 | 0.7 | public domain | (?:released|dedicated|placed|published|put) (?:in|into|to) the public domain
public-domain | 3 | 0.7 | public domain | this (?:file|code|software|work|text|book|ebook|document) is (?:in|hereby placed in|part of) the public domain
public-domain | 3 | 0.7 | no copyright | no copyright is claimed
public-domain-us-gov | 3 | 0.75 | united states government | work of the united states government(?: and is)? (?:not subject to copyright|in the public domain)
proprietary | 3 | 0.7 | all rights reserved | all rights reserved
proprietary | 3 | 0.75 | proprietary and confidential | proprietary and confidential unauthorized copying
proprietary | 3 | 0.75 | no part of this | no part of this (?:publication|book|work|document) may be reproduced
proprietary | 3 | 0.7 | end user licen | end user license agreement
proprietary | 3 | 0.7 | non transferable | (?:a )?(?:limited )?non exclusive non transferable (?:revocable )?license
freeware | 2 | 0.65 | freeware | this (?:software|program) is (?:distributed as )?freeware under licen[cs]e
noncommercial | 2 | 0.7 | non commercial use only | licen[cs]ed for non commercial use only
noncommercial | 2 | 0.65 | personal and non commercial | permission is granted for personal and non commercial use
research-only | 2 | 0.7 | research purposes only | licen[cs]ed for (?:academic )?research purposes only
"""

#: Words that most statements hold; every rule's match holds one of ``gate()``, and a text without any is done.
GATE = ("licens", "licenc", "spdx", "cc by", "cc0", "permission", "redistribut", "advertising", "provided as is", "unencumbered", "public domain", "rights reserved", "neither the name", "under the", "under mit", "governed by", "subject to", "covered by", "accordance with", "compliance with", " under ", "creative commons", "what the")


def gate() -> list[str]:
    """The gate's words, and the keywords of signatures that need not hold any of them."""
    signatures = [[c.strip() for c in line.split(" | ", 4)] for line in SENTENCES.strip().splitlines()]
    fixed = lambda pattern: re.sub(r"\(\?:[^()]*\)\??", "", pattern).replace("[cs]", "s")
    return [*GATE, *sorted({x[3] for x in signatures if not any(g.strip() in fixed(x[4]) for g in GATE)})]


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, pattern) of every rule, highest priority first."""
    named = [[c.strip() for c in line.split(" | ", 2)] for line in NAMED.strip().splitlines()]
    stated = [[c.strip() for c in line.split(" | ", 3)] for line in STATED.strip().splitlines()]
    out = [(label, int(p), float(c), key, f" {form.replace('{name}', f'(?:{name})')}(?= )") for _, p, c, form in stated for label, key, name in named]
    for line in SENTENCES.strip().splitlines():
        label, p, c, key, pattern = (x.strip() for x in line.split(" | ", 4))
        out.append((label, int(p), float(c), key, f" {pattern}(?= )"))
    out += [(label, 4, 0.9, phrase, f" {phrase}(?= )") for phrase, label in BASE.items()]
    return sorted(out, key=lambda r: -r[1])


def reduced(text: Column) -> Column:
    """The text's words (A-Z lowered), each with a space before it, and a last space.

    ``lower`` also changes other letters, but only two of them into A-Z: these are put aside first.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("")), F.lit("İ"), F.lit(""))
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(plain), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """Start and end (in words) of each match, from the words in and between the matches."""
    found = F.regexp_extract_all(words, pattern, F.lit(0))

    def of(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(words, pattern, -1), 1, F.size(found)), _spaces)
        steps = F.zip_with(gaps, F.transform(found, _spaces), lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        starts = running_sums(F.transform(steps, lambda x: (x["g"] + x["n"]).cast("long")))
        return F.zip_with(starts, steps, lambda at, x: F.struct((at + x["g"]).cast("int").alias("start"), (at + x["g"] + x["n"]).cast("int").alias("stop")))

    return let(found, of)


def _labelled(places: Column, label: Column, priority: Column, confidence: Column) -> Column:
    return F.transform(places, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), label.alias("label"), priority.alias("priority"), confidence.alias("confidence")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, detections): base and kept detections as arrays of (start, stop, label, priority, confidence)."""
    table = rules()
    kind = "array<struct<start:int,stop:int,label:string,priority:int,confidence:double>>"
    keys = sorted({r[3] for r in table})
    spec = F.array(*[F.struct(F.lit(r[0]).alias("label"), F.lit(r[1]).alias("priority"), F.lit(r[2]).alias("confidence"), F.lit(r[3]).alias("key"), F.lit(r[4]).alias("pattern")) for r in table])
    d = docs.select(F.col(id_col).alias("id"), reduced(F.col(text_col)).alias("w"))
    opened = F.lit(False)
    for g in gate():
        opened = opened | F.contains("w", F.lit(g))
    d = d.withColumn("gate", opened).withColumn("n_words", F.greatest(_spaces(F.col("w")) - 1, F.lit(0)).cast("long"))
    base = F.flatten(F.array(*[_labelled(_places(F.col("w"), F.lit(f" {p}(?= )")), F.lit(label), F.lit(4), F.lit(0.9)) for p, label in BASE.items()]))
    has = F.contains("w", F.lit("license")) | F.contains("w", F.lit("cc by nc"))
    d = d.withColumn("base", F.when(has, base).otherwise(F.array().cast(kind)).cast(kind))
    present = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(F.col("w"), k))
    d = d.withColumn("present", F.when(F.col("gate"), present).otherwise(F.array().cast("array<string>")))
    run = F.flatten(
        F.transform(
            F.filter(spec, lambda r: F.array_contains(F.col("present"), r["key"])),
            lambda r: _labelled(_places(F.col("w"), r["pattern"]), r["label"], r["priority"], r["confidence"]),
        )
    )
    d = d.withColumn("raw", F.when(F.size("present") > 0, run).otherwise(F.array().cast(kind)).cast(kind))
    d = d.withColumn("kept", _resolve(F.col("raw"), kind))
    return d.select("id", "n_words", "base", F.col("kept").alias("detections"))


def _resolve(raw: Column, kind: str) -> Column:
    """Without detections that lie within an earlier one of the same or a higher priority.

    Earlier detections are looked up in blocks, whole ones by their farthest
    end for each priority, so that cost grows with m times the root of m.
    """
    ordered = F.transform(F.array_sort(F.transform(raw, lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("back"), (-m["priority"]).alias("low"), m["label"].alias("label"), m["confidence"].alias("confidence")))), lambda m: F.struct(m["start"].alias("start"), (-m["back"]).alias("stop"), m["label"].alias("label"), (-m["low"]).alias("priority"), m["confidence"].alias("confidence")))

    def farthest(block: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(TIERS)), lambda t: F.aggregate(block, F.lit(-1), lambda far, m: F.when(m["priority"] >= t, F.greatest(far, m["stop"])).otherwise(far)))

    def of(parts: Column) -> Column:
        def open_ones(far: Column) -> Column:
            def kept(block: Column, k: Column) -> Column:
                covered = lambda m, i: F.exists(F.slice(block, 1, i), lambda q: (q["priority"] >= m["priority"]) & (q["stop"] >= m["stop"])) | F.exists(F.slice(far, 1, k), lambda t: F.element_at(t, m["priority"]) >= m["stop"])
                return F.filter(block, lambda m, i: ~covered(m, i))

            return F.flatten(F.transform(parts, kept))

        return let(F.transform(parts, farthest), open_ones)

    return let(ordered, lambda o: let(blocks(o), of)).cast(kind)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts = F.transform("base", lambda m: m["start"])
    label = lambda c: F.transform(c, lambda m: m["label"])
    base = F.array_sort(F.array_distinct(label("base")))
    both = F.array_sort(F.array_distinct(F.concat(label("base"), label("detections"))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("base", lambda m: m["confidence"])), F.lit(0.0)), F.coalesce(F.array_max(F.transform("detections", lambda m: m["confidence"])), F.lit(0.0)))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"),
    )
