"""Signature rules of licenses, written by hand.

One rule a line: label | priority | keyword | pattern. Patterns match the
stream of lower-cased words with one blank between them, on whole words.
``V2`` stands for an optional 'version' before the number, ``OLL`` for 'or
later', written in any of their usual ways. The keyword is a word or phrase
without which the pattern cannot match. Priorities: 90 full grants and
identifiers, 70 names with a version, 50 names, 30 hints.
"""

from __future__ import annotations

V = r"(?:v|version )?"
LATER = r"(?: or(?: at your option)? any later(?: version)?| or later| plus)"

RULES_TEXT = r"""
agpl-3.0-or-later | 90 | affero | gnu affero general public license(?: as published by the free software foundation)?(?: either)? {V}3(?: 0)?(?: of the license)?{LATER}
agpl-3.0-or-later | 90 | agpl | agpl {V}3(?: 0)?{LATER}
agpl-3.0 | 70 | affero | gnu affero general public license {V}3(?: 0)?
agpl-3.0 | 70 | agpl | agpl {V}3(?: 0)?(?: only)?
agpl-1.0 | 70 | affero | affero general public license {V}1(?: 0)?
agpl | 50 | affero | (?:gnu )?affero general public license
agpl | 50 | agpl | (?:gnu )?agpl
lgpl-3.0-or-later | 90 | lesser | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? {V}3(?: 0)?(?: of the license)?{LATER}
lgpl-2.1-or-later | 90 | lesser | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? {V}2 1(?: of the license)?{LATER}
lgpl-2.0-or-later | 90 | library | gnu library general public license(?: as published by the free software foundation)?(?: either)? {V}2(?: 0)?(?: of the license)?{LATER}
lgpl-3.0-or-later | 90 | lgpl | lgpl {V}3(?: 0)?{LATER}
lgpl-2.1-or-later | 90 | lgpl | lgpl {V}2 1{LATER}
lgpl-3.0 | 70 | lesser | gnu lesser general public license {V}3(?: 0)?
lgpl-2.1 | 70 | lesser | gnu lesser general public license {V}2 1
lgpl-2.0 | 70 | library | gnu library general public license {V}2(?: 0)?
lgpl-3.0 | 70 | lgpl | lgpl {V}3(?: 0)?(?: only)?
lgpl-2.1 | 70 | lgpl | lgpl {V}2 1(?: only)?
lgpl-2.0 | 70 | lgpl | lgpl {V}2(?: 0)?(?: only)?
lgpl | 50 | lesser | (?:gnu )?lesser general public license
lgpl | 50 | library | (?:gnu )?library general public license
lgpl | 50 | lgpl | (?:gnu )?lgpl
gpl-3.0-or-later | 90 | gnu general | gnu general public license(?: as published by the free software foundation)?(?: either)? {V}3(?: 0)?(?: of the license)?{LATER}
gpl-2.0-or-later | 90 | gnu general | gnu general public license(?: as published by the free software foundation)?(?: either)? {V}2(?: 0)?(?: of the license)?{LATER}
gpl-1.0-or-later | 90 | gnu general | gnu general public license(?: as published by the free software foundation)?(?: either)? {V}1(?: 0)?(?: of the license)?{LATER}
gpl-3.0-or-later | 90 | gpl | gpl {V}3(?: 0)?{LATER}
gpl-2.0-or-later | 90 | gpl | gpl {V}2(?: 0)?{LATER}
gpl-3.0 | 70 | gnu general | gnu general public license {V}3(?: 0)?
gpl-2.0 | 70 | gnu general | gnu general public license {V}2(?: 0)?
gpl-1.0 | 70 | gnu general | gnu general public license {V}1(?: 0)?
gpl-3.0 | 70 | gpl | gpl {V}3(?: 0)?(?: only)?
gpl-2.0 | 70 | gpl | gpl {V}2(?: 0)?(?: only)?
gpl-3.0 | 70 | gplv3 | gplv3
gpl-2.0 | 70 | gplv2 | gplv2
gpl | 50 | gnu general | gnu general public licen[sc]e
gpl | 50 | gpl | gnu gpl
gpl-hint | 30 | free software foundation | free software foundation inc
gpl-linking-exception | 90 | linking exception | gpl(?: {V}\d(?: 0)?)? with(?: the)? linking exception
gpl-classpath-exception | 90 | classpath exception | (?:gpl(?: {V}\d(?: 0)?)? with(?: the)? )?classpath exception(?: 2 0)?
gpl-font-exception | 90 | font exception | gpl(?: {V}\d(?: 0)?)? with(?: the)? font exception
gpl-bison-exception | 90 | bison exception | (?:gpl with(?: the)? )?bison exception(?: 2 2)?
gpl-gcc-exception | 90 | runtime library exception | gcc runtime library exception(?: {V}3 1)?
gfdl-1.3-or-later | 90 | free documentation | gnu free documentation license {V}1 3{LATER}
gfdl-1.2-or-later | 90 | free documentation | gnu free documentation license {V}1 2{LATER}
gfdl-1.3 | 70 | free documentation | gnu free documentation license {V}1 3
gfdl-1.2 | 70 | free documentation | gnu free documentation license {V}1 2
gfdl-1.1 | 70 | free documentation | gnu free documentation license {V}1 1
gfdl | 50 | free documentation | gnu free documentation license
gfdl | 50 | gfdl | gfdl(?: 1 [123])?
apache-2.0 | 90 | apache | licensed under the apache license {V}2(?: 0)?(?: the license)?
apache-2.0 | 70 | apache | apache(?: software)? licen[sc]e {V}2(?: 0)?
apache-2.0 | 70 | apache | apache {V}2(?: 0)?(?: licen[sc]ed?)?
apache-1.1 | 70 | apache | apache(?: software)? licen[sc]e {V}1 1
apache-1.0 | 70 | apache | apache(?: software)? licen[sc]e {V}1 0
apache-2.0-llvm | 90 | llvm | apache(?: license)? {V}2 0 with llvm exceptions?
apache | 50 | apache | apache(?: software)? licen[sc]e
mit | 90 | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 90 | mit | (?:released|licensed|distributed|available) under(?: the)?(?: terms of the)? mit licen[sc]e
mit-0 | 90 | mit no attribution | mit no attribution(?: license)?
mit-0 | 70 | mit 0 | mit 0
mit-cmu | 70 | cmu | (?:mit cmu|cmu license)
mit-advertising | 70 | mit | mit license with advertising clause
mit-modern | 70 | mit | mit license modern variant
x11 | 70 | x11 | (?:mit )?x11 licen[sc]e
x-consortium | 90 | x consortium | the name of the x consortium shall not be used in advertising
mit | 50 | mit | (?:the )?mit licen[sc]e
expat | 70 | expat | expat licen[sc]e
mit-warranty | 30 | as is | the software is provided as is without warranty of any kind
isc | 90 | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 70 | isc | isc licen[sc]e
0bsd | 90 | zero clause | (?:bsd )?zero clause(?: bsd)?(?: license)?
0bsd | 70 | 0bsd | 0bsd
0bsd | 70 | bsd 0 | bsd 0 clause
bsd-1-clause | 70 | clause | (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-2-clause | 70 | clause | (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: license)?
bsd-2-clause | 50 | simplified bsd | simplified bsd
bsd-2-clause-patent | 90 | clause | bsd 2 clause(?: plus)? patent(?: license)?
bsd-2-clause-views | 90 | clause | bsd 2 clause(?: with)? views(?: sentence)?
bsd-3-clause | 70 | clause | (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?
bsd-3-clause-clear | 90 | clause | bsd 3 clause clear(?: license)?
bsd-3-clause-lbnl | 90 | lbnl | bsd 3 clause lbnl
bsd-3-clause-lbnl | 90 | lawrence berkeley | lawrence berkeley national labs bsd variant license
bsd-4-clause | 70 | clause | (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: license)?
bsd-2-clause | 70 | simplified bsd | simplified bsd licen[sc]e
bsd-3-clause | 70 | new bsd | new bsd licen[sc]e
bsd-3-clause | 70 | modified bsd | modified bsd licen[sc]e
bsd-3-clause | 70 | revised bsd | revised bsd licen[sc]e
bsd-2-clause | 70 | freebsd | freebsd licen[sc]e
bsd-4-clause | 70 | original bsd | original bsd licen[sc]e
bsd-redistribution | 90 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-endorsement | 90 | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
bsd | 50 | bsd | bsd(?: style| like)? licen[sc]e
mpl-2.0 | 90 | mozilla | this source code form is subject to the terms of the mozilla public license {V}2 0
mpl-2.0 | 70 | mozilla | mozilla public license {V}2(?: 0)?
mpl-1.1 | 70 | mozilla | mozilla public license {V}1 1
mpl-1.0 | 70 | mozilla | mozilla public license {V}1 0
mpl-2.0 | 70 | mpl | mpl {V}2(?: 0)?
mpl-1.1 | 70 | mpl | mpl {V}1 1
mpl-no-copyleft | 90 | incompatible with secondary | incompatible with secondary licenses
mpl | 50 | mozilla | mozilla public license
epl-2.0 | 70 | eclipse | eclipse public license {V}2(?: 0)?
epl-1.0 | 70 | eclipse | eclipse public license {V}1 0
epl-2.0 | 70 | epl | epl {V}2(?: 0)?
epl-1.0 | 70 | epl | epl {V}1 0
edl-1.0 | 70 | eclipse | eclipse distribution license {V}1 0
epl | 50 | eclipse | eclipse public license
cddl-1.1 | 70 | cddl | cddl {V}1 1
cddl-1.0 | 70 | cddl | cddl {V}1 0
cddl | 50 | common development | common development and distribution license(?: {V}1 [01])?
cddl | 50 | cddl | cddl
cpl-1.0 | 70 | common public | common public license {V}1 0
cpl | 50 | common public | common public license
cpal-1.0 | 70 | attribution | common public attribution license(?: {V}1 0)?
ipl-1.0 | 70 | ibm public | ibm public license(?: {V}1 0)?
eupl-1.2 | 70 | eupl | eupl {V}1 2
eupl-1.1 | 70 | eupl | eupl {V}1 1
eupl | 50 | european union public | european union public licen[sc]e(?: {V}1 [012])?
osl-3.0 | 70 | open software | open software license {V}3(?: 0)?
osl-2.1 | 70 | open software | open software license {V}2 1
osl | 50 | open software | open software license
afl-3.0 | 70 | academic free | academic free license {V}3(?: 0)?
afl-2.1 | 70 | academic free | academic free license {V}2 1
afl | 50 | academic free | academic free license
artistic-2.0 | 70 | artistic | artistic license {V}2(?: 0)?
artistic-1.0 | 70 | artistic | artistic license {V}1(?: 0)?
artistic-perl | 90 | perl | same terms as perl(?: itself)?
artistic | 50 | artistic | artistic licen[sc]e
clarified-artistic | 70 | clarified artistic | clarified artistic license
bsl-1.0 | 70 | boost | boost software license(?: {V}1 0)?
bsl-1.0 | 90 | boost | distributed under the boost software license {V}1 0
busl-1.1 | 70 | business source | business source license(?: {V}1 1)?
sspl-1.0 | 70 | server side public | server side public license(?: {V}1(?: 0)?)?
elastic-2.0 | 70 | elastic | elastic license {V}2(?: 0)?
elastic | 50 | elastic | elastic license
commons-clause | 70 | commons clause | commons clause(?: license)?(?: condition)?(?: {V}1 0)?
polyform-noncommercial | 70 | polyform | polyform noncommercial license(?: 1 0 0)?
polyform-small-business | 70 | polyform | polyform small business license(?: 1 0 0)?
polyform-shield | 70 | polyform | polyform shield license(?: 1 0 0)?
prosperity | 70 | prosperity | prosperity public license(?: 3 0 0)?
parity | 70 | parity public | parity public license(?: 7 0 0| 6 0 0)?
ssal | 50 | source available | source available license
unlicense | 90 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 70 | unlicense | (?:the )?unlicense
wtfpl | 70 | what the | do what the f\w* you want to public license(?: {V}2)?
wtfpl | 70 | wtfpl | wtfpl
zlib | 90 | altered source | altered source versions must be plainly marked as such
zlib | 70 | zlib | zlib(?: libpng)? licen[sc]e
libpng | 70 | libpng | libpng licen[sc]e(?: {V}2)?
libtiff | 70 | libtiff | libtiff licen[sc]e
ijg | 70 | jpeg group | independent jpeg group license
curl | 70 | curl | curl licen[sc]e
openssl | 70 | openssl | openssl licen[sc]e
ssleay | 70 | ssleay | ssleay licen[sc]e
openssl | 90 | openssl toolkit | for use in the openssl toolkit
php-3.01 | 70 | php | php license {V}3 01
php | 50 | php | php license
python-2.0 | 70 | python | python(?: software foundation)? license {V}2(?: 0)?
psf | 50 | python software | python software foundation license
cnri | 70 | cnri | cnri (?:python )?(?:open source )?license
ruby | 70 | ruby | ruby licen[sc]e
vim | 70 | vim | vim licen[sc]e
tcl | 70 | tcl | tcl(?: tk)? licen[sc]e
postgresql | 70 | postgresql | postgresql licen[sc]e
ncsa | 70 | ncsa | (?:university of illinois )?ncsa(?: open source)? license
ncsa | 70 | university of illinois | university of illinois(?: ncsa)? open source license
w3c | 70 | w3c | w3c(?: software)?(?: notice and)? license
w3c-document | 70 | w3c | w3c document license
ofl-1.1 | 70 | open font | sil open font license(?: {V}1 1)?
ofl-1.0 | 70 | open font | sil open font license {V}1 0
ofl | 50 | open font | open font license
ofl-reserved | 90 | reserved font | with reserved font names?
ubuntu-font | 70 | ubuntu font | ubuntu font licen[sc]e(?: {V}1 0)?
bitstream-vera | 70 | bitstream vera | bitstream vera(?: fonts?)? license
lppl-1.3c | 70 | latex | latex project public license {V}1 3c?
lppl | 50 | latex | latex project public license
lppl | 50 | lppl | lppl(?: 1 3c?)?
ms-pl | 70 | microsoft public | microsoft public license(?: ms pl)?
ms-rl | 70 | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
ms-lpl | 70 | limited public | microsoft limited public license
qpl-1.0 | 70 | q public | q public license(?: {V}1 0)?
sleepycat | 70 | sleepycat | sleepycat licen[sc]e
sun-sissl | 70 | sun industry | sun industry standards source license
nasa-1.3 | 70 | nasa | nasa open source agreement(?: {V}1 3)?
nosl | 70 | netizen | netizen open source license
npl-1.1 | 70 | netscape | netscape public license(?: {V}1 [01])?
apsl-2.0 | 70 | apple public | apple public source license(?: {V}(?:1|2)(?: [0-2])?)?
rpl-1.5 | 70 | reciprocal public | reciprocal public license(?: {V}1 [15])?
rpsl | 70 | realnetworks | realnetworks public source license
watcom | 70 | watcom | sybase open watcom public license(?: 1 0)?
wxwindows | 70 | wxwindows | wxwindows library licen[sc]e
fltk | 70 | fltk | fltk license
zpl-2.1 | 70 | zope | zope public license(?: {V}[12] [01])?
ecl-2.0 | 70 | educational community | educational community license(?: {V}[12] 0)?
entessa | 70 | entessa | entessa public license
frameworx | 70 | frameworx | frameworx open license
intel | 70 | intel open | intel open source license
lucent | 70 | lucent | lucent public license(?: {V}1 0[02]?)?
motosoto | 70 | motosoto | motosoto license
nokia | 70 | nokia | nokia open source license
oclc | 70 | oclc | oclc research public license
oset | 70 | oset | oset public license
simpl | 70 | simple public | simple public license(?: 2 0)?
vsl | 70 | vovida | vovida software license
xnet | 70 | x net | x net license
upl-1.0 | 70 | universal permissive | universal permissive license(?: {V}1 0)?
blueoak-1.0.0 | 70 | blue oak | blue oak model license(?: 1 0 0)?
mulan-psl-2.0 | 70 | mulan | mulan permissive software license(?: {V}[12](?: 0)?)?
mulan-psl-2.0 | 70 | mulan | mulan psl(?: {V}2)?
cecill-2.1 | 70 | cecill | cecill(?: free software)?(?: license)?(?: agreement)?(?: {V}2(?: [01])?)?
cecill-b | 70 | cecill | cecill b(?: free software)?(?: license)?
cecill-c | 70 | cecill | cecill c(?: free software)?(?: license)?
liliq | 70 | liliq | liliq (?:p|r|rplus)(?: 1 1)?
openldap | 70 | openldap | openldap public license(?: {V}2(?: \d)?)?
beerware | 70 | beerware | (?:the )?beerware license(?: revision 42)?
beerware | 70 | beer ware | (?:the )?beer ware license(?: revision 42)?
json | 90 | used for good | the software shall be used for good not evil
json | 70 | json | json license
hippocratic | 70 | hippocratic | hippocratic license(?: {V}\d(?: \d)?)?
anti-996 | 70 | 996 | anti 996 license
sgi-b-2.0 | 70 | sgi | sgi free software license b(?: {V}\d \d)?
unicode-dfs | 70 | unicode | unicode(?: inc)? license agreement(?: data files and software)?
icu | 70 | icu | icu licen[sc]e
afpl | 70 | aladdin | aladdin free public license
bittorrent | 70 | bittorrent | bittorrent open source license(?: {V}1 [01])?
catosl | 70 | computer associates | computer associates trusted open source license
cua-opl | 70 | cua office | cua office public license
efl-2.0 | 70 | eiffel | eiffel forum license(?: {V}[12])?
eudatagrid | 70 | eu datagrid | eu datagrid software license
fair | 70 | fair license | fair license
hpnd | 70 | historical permission | historical permission notice and disclaimer
jabber | 70 | jabber | jabber open source license
miros | 70 | miros | miros licen[sc]e
multics | 70 | multics | multics license
naumen | 70 | naumen | naumen public license
ngpl | 70 | nethack | nethack general public license
osl-atom | 70 | open group | open group test suite license
cdla-permissive-2.0 | 70 | community data | community data license agreement permissive(?: {V}[12] 0)?
cdla-sharing-1.0 | 70 | community data | community data license agreement sharing(?: {V}1 0)?
odbl-1.0 | 70 | database | open(?: data commons)?(?: open)? database license(?: odbl)?(?: {V}1 0)?
odc-by-1.0 | 70 | open data commons | open data commons attribution license(?: {V}1 0)?
pddl-1.0 | 70 | public domain dedication | (?:open data commons )?public domain dedication and licen[sc]e(?: {V}1 0)?
ogl-3.0 | 70 | open government | open government licen[sc]e(?: {V}[123](?: 0)?)?
ogl-canada | 90 | canada | open government licence canada(?: 2 0)?
etalab-2.0 | 70 | etalab | etalab open license(?: {V}[12] 0)?
etalab-2.0 | 70 | ouverte | licence ouverte(?: {V}[12] 0)?
dl-de-by-2.0 | 70 | datenlizenz | datenlizenz deutschland namensnennung(?: {V}2 0)?
dl-de-zero-2.0 | 70 | datenlizenz | datenlizenz deutschland zero(?: {V}2 0)?
openrail | 50 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
openrail | 50 | open rail | (?:creativeml |bigscience )?open rail(?: m)?(?: license)?
openrail-m | 70 | creativeml | creativeml open rail m(?: license)?
rail-1.0 | 70 | responsible ai | responsible ai license
public-domain | 90 | public domain | (?:released|dedicated|placed) (?:in|in ?to|to) the public domain
public-domain | 50 | public domain | (?:is|are) in the public domain
cc0-1.0 | 90 | cc0 | cc0(?: {V}1 0)?(?: universal)?(?: public domain dedication)?
cc-pdm | 70 | public domain mark | public domain mark(?: {V}1 0)?
all-rights-reserved | 30 | all rights reserved | all rights reserved
proprietary | 70 | proprietary and confidential | proprietary and confidential
proprietary | 50 | unauthorized copying | unauthorized copying of this file
spdx | 30 | spdx license identifier | spdx license identifier
freeware | 50 | freeware | freeware licen[sc]e
shareware | 50 | shareware | shareware licen[sc]e
license-grant | 30 | licensed under | licensed under(?: the)?(?: terms of)?
license-grant | 30 | licenciado bajo | licenciado bajo(?: la)? licencia
license-grant | 30 | lizenziert unter | lizenziert unter(?: der)?(?: lizenz)?
license-grant | 30 | sous licence | (?:distribué |publié )?sous licence
license-file | 30 | license file | see the(?: accompanying)? license file(?: for details)?
"""

#: Creative Commons: abbreviations and their long names; each comes with and without a version.
CREATIVE_COMMONS = (
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nd", "attribution no ?deriv(?:ative)?s"),
    ("by nc", "attribution non ?commercial"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in order of writing."""
    found = []
    for line in RULES_TEXT.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        found.append((label, int(priority), keyword, pattern.replace("{V}", V).replace("{LATER}", LATER)))
    for short, long in CREATIVE_COMMONS:
        name = "cc-" + short.replace(" ", "-")
        for version in CC_VERSIONS:
            label = f"{name}-{version.replace(' ', '.')}"
            found.append((label, 90, "cc by", rf"cc {short} {version}(?: international| unported)?"))
            found.append((label, 90, "creative commons", rf"creative commons {long} {version}(?: international| unported)?(?: license)?"))
        found.append((name, 70 if " " in short else 50, "cc by", rf"cc {short}"))
        found.append((name, 50, "creative commons", rf"creative commons {long}(?: license)?"))
    return found
