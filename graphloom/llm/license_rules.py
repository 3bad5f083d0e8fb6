"""The rules of license_scan: license | priority | keyword | pattern, one a line.

A space in a pattern stands for white space with comment marks around it. The keyword is
lower-case words that every match of the pattern contains; the pattern ignores case.
Priorities: 90 grants and licence texts, 80 SPDX tags, 70 addresses, 60 notices by
full name, 40 names, 20 traces.
"""

RULES = r"""
Apache-2.0|90|apache license|licensed under the apache license, version 2\.0(?: \(the "?license"?\))?
Apache-2.0|90|apache license|you may not use this file except in compliance with the license\. you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0[^.]{0,80}apache license
Apache-2.0|80|spdx-license-identifier: apache-2.0|spdx-license-identifier: apache-2\.0(?![\w.-])
Apache-2.0|70|apache.org/licenses/license-2.0|https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-2.0|60|apache license|apache license,? (?:version |v\.? ?)2(?:\.0)?
Apache-2.0|40|apache-2.0|(?<![\w.-])apache-2\.0(?![\w.-])
Apache-2.0|40|apache software license|apache software license,? (?:version )?2(?:\.0)?
Apache-1.1|60|apache software license|apache software license,? version 1\.1
Apache-1.1|80|spdx-license-identifier: apache-1.1|spdx-license-identifier: apache-1\.1(?![\w.-])
Apache-1.0|60|apache software license|apache software license,? version 1\.0
Apache-1.0|80|spdx-license-identifier: apache-1.0|spdx-license-identifier: apache-1\.0(?![\w.-])
Apache-unversioned|20|apache license|apache license
MIT|90|permission is hereby granted, free of charge|permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT|90|the software is provided "as is"|the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
MIT|90|mit licen|(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
MIT|80|spdx-license-identifier: mit|spdx-license-identifier: mit(?![\w.-])
MIT|70|opensource.org/license /mit|https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license(?:\.php)?)?
MIT|70|mit-license.org|https?://(?:www\.)?mit-license\.org
MIT|60|the mit license|the mit license(?: \(mit\))?
MIT|40|mit license|mit license
MIT|40|mit licence|mit licence
MIT|40|expat licen|expat licen[sc]e
MIT-0|80|spdx-license-identifier: mit-0|spdx-license-identifier: mit-0(?![\w.-])
MIT-0|60|mit no attribution|mit no attribution(?: license)?
X11|80|spdx-license-identifier: x11|spdx-license-identifier: x11(?![\w.-])
X11|60|x11 license|x11 license
BSD-2-Clause|80|spdx-license-identifier: bsd-2-clause|spdx-license-identifier: bsd-2-clause(?![\w.-])
BSD-2-Clause|60|simplified bsd license|simplified bsd license
BSD-2-Clause|60|2-clause bsd|2-clause bsd(?: license)?
BSD-2-Clause|60|two-clause bsd|two-clause bsd(?: license)?
BSD-2-Clause|60|bsd 2-clause|bsd 2-clause(?: license)?
BSD-2-Clause|60|freebsd license|freebsd license
BSD-2-Clause|40|bsd-2-clause|(?<![\w.-])bsd-2-clause(?![\w.-])
BSD-2-Clause|70|opensource.org/license /bsd-2-clause|https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause
BSD-3-Clause|80|spdx-license-identifier: bsd-3-clause|spdx-license-identifier: bsd-3-clause(?![\w.-])
BSD-3-Clause|90|neither the name of|neither the name of [^.]{1,120} nor the names of (?:its|any|the)? ?contributors may be used to endorse or promote products
BSD-3-Clause|90|use of this source code is governed by a bsd-style|use of this source code is governed by a bsd-style license
BSD-3-Clause|60|3-clause bsd|3-clause bsd(?: license)?
BSD-3-Clause|60|three-clause bsd|three-clause bsd(?: license)?
BSD-3-Clause|60|bsd 3-clause|bsd 3-clause(?: "?new"? or "?revised"?)?(?: license)?
BSD-3-Clause|60|new bsd license|new bsd license
BSD-3-Clause|60|modified bsd license|modified bsd license
BSD-3-Clause|60|revised bsd license|revised bsd license
BSD-3-Clause|40|bsd-3-clause|(?<![\w.-])bsd-3-clause(?![\w.-])
BSD-3-Clause|70|opensource.org/license /bsd-3-clause|https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause
BSD-4-Clause|80|spdx-license-identifier: bsd-4-clause|spdx-license-identifier: bsd-4-clause(?![\w.-])
BSD-4-Clause|90|all advertising materials mentioning features|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-4-Clause|60|4-clause bsd|4-clause bsd(?: license)?
BSD-4-Clause|60|original bsd license|original bsd license
0BSD|80|spdx-license-identifier: 0bsd|spdx-license-identifier: 0bsd(?![\w.-])
0BSD|60|zero-clause bsd|zero-clause bsd(?: license)?
0BSD|90|permission to use, copy, modify, and/or distribute|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software
BSD-unspecified|90|redistribution and use in source and binary forms|redistribution and use in source and binary forms,? with or without modification, are permitted provided
BSD-unspecified|60|under the bsd license|under the (?:terms of the )?bsd license
BSD-unspecified|60|bsd-style license|bsd-style license
BSD-unspecified|20|bsd license|bsd license
BSD-unspecified|20|bsd licence|bsd licence
ISC|90|permission to use, copy, modify, and|permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
ISC|80|spdx-license-identifier: isc|spdx-license-identifier: isc(?![\w.-])
ISC|60|isc license|isc license
ISC|70|opensource.org/license /isc|https?://(?:www\.)?opensource\.org/licenses?/isc(?:-license)?
GPL-1.0|80|spdx-license-identifier: gpl-1.0|spdx-license-identifier: gpl-1\.0(?:-only|-or-later|\+)?(?![\w.-])
GPL-1.0|60|general public license|gnu general public license,? (?:version |v\.? ?)1(?![\d.])
GPL-2.0-only|80|spdx-license-identifier: gpl-2.0|spdx-license-identifier: gpl-2\.0(?:-only)?(?![\w.+-])
GPL-2.0-or-later|80|spdx-license-identifier: gpl-2.0|spdx-license-identifier: gpl-2\.0(?:-or-later|\+)(?![\w.-])
GPL-2.0-or-later|90|general public license|under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or \(at your option\) any later version
GPL-2.0-only|90|general public license|under the terms of the gnu general public license,? version 2,? as published by the free software foundation
GPL-2.0-or-later|90|general public license|gnu general public license,? (?:version |v\.? ?)2(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later
GPL-2.0|60|general public license|gnu general public license,? (?:version |v\.? ?)2(?:\.0)?
GPL-2.0|60|general public licence|gnu general public licence,? (?:version |v\.? ?)2(?:\.0)?
GPL-2.0|60|gnu gpl|gnu gpl,? ?(?:version |v\.? ?)2(?:\.0)?
GPL-2.0|40|gplv2|(?<!\w)gplv2\+?(?!\w)
GPL-2.0|40|gpl-2.0|(?<![\w.-])gpl-2\.0(?:-only|-or-later|\+)?(?![\w.-])
GPL-2.0|70|gnu.org/licenses/old-licenses/gpl-2.0|https?://(?:www\.)?gnu\.org/licenses/old-licenses/gpl-2\.0(?:\.\w+)?
GPL-3.0-only|80|spdx-license-identifier: gpl-3.0|spdx-license-identifier: gpl-3\.0(?:-only)?(?![\w.+-])
GPL-3.0-or-later|80|spdx-license-identifier: gpl-3.0|spdx-license-identifier: gpl-3\.0(?:-or-later|\+)(?![\w.-])
GPL-3.0-or-later|90|general public license|under the terms of the gnu general public license as published by the free software foundation,? either version 3 of the license, or \(at your option\) any later version
GPL-3.0-only|90|general public license|under the terms of the gnu general public license,? version 3,? as published by the free software foundation
GPL-3.0-or-later|90|general public license|gnu general public license,? (?:version |v\.? ?)3(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later
GPL-3.0|60|general public license|gnu general public license,? (?:version |v\.? ?)3(?:\.0)?
GPL-3.0|60|general public licence|gnu general public licence,? (?:version |v\.? ?)3(?:\.0)?
GPL-3.0|60|gnu gpl|gnu gpl,? ?(?:version |v\.? ?)3(?:\.0)?
GPL-3.0|40|gplv3|(?<!\w)gplv3\+?(?!\w)
GPL-3.0|40|gpl-3.0|(?<![\w.-])gpl-3\.0(?:-only|-or-later|\+)?(?![\w.-])
GPL-3.0|70|gnu.org/licenses/gpl-3.0|https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.\w+)?
GPL-unversioned|70|gnu.org/licenses/gpl.html|https?://(?:www\.)?gnu\.org/licenses/gpl\.html
GPL-unversioned|60|general public license|under the (?:terms of the )?gnu general public license
GPL-unversioned|20|gnu general public license|gnu general public license
GPL-unversioned|20|gnu gpl|gnu gpl(?!\w)
GPL-CC-1.0|60|gpl cooperation commitment|gpl cooperation commitment
Classpath-exception-2.0|80|classpath-exception-2.0|with classpath-exception-2\.0
Classpath-exception-2.0|60|classpath exception|classpath exception
GCC-exception-3.1|80|gcc-exception-3.1|with gcc-exception-3\.1
GCC-exception-3.1|60|gcc runtime library exception|gcc runtime library exception
LGPL-2.0|80|spdx-license-identifier: lgpl-2.0|spdx-license-identifier: lgpl-2\.0(?:-only|-or-later|\+)?(?![\w.-])
LGPL-2.0|60|library general public license|gnu library general public license(?:,? (?:version |v\.? ?)2(?:\.0)?)?
LGPL-2.1-only|80|spdx-license-identifier: lgpl-2.1|spdx-license-identifier: lgpl-2\.1(?:-only)?(?![\w.+-])
LGPL-2.1-or-later|80|spdx-license-identifier: lgpl-2.1|spdx-license-identifier: lgpl-2\.1(?:-or-later|\+)(?![\w.-])
LGPL-2.1-or-later|90|lesser general public license|under the terms of the gnu lesser general public license as published by the free software foundation; either version 2\.1 of the license, or \(at your option\) any later version
LGPL-2.1|60|lesser general public license|gnu lesser general public license,? (?:version |v\.? ?)2\.1
LGPL-2.1|40|lgplv2.1|(?<!\w)lgplv2\.1\+?(?!\w)
LGPL-2.1|40|lgpl-2.1|(?<![\w.-])lgpl-2\.1(?:-only|-or-later|\+)?(?![\w.-])
LGPL-2.1|70|gnu.org/licenses/old-licenses/lgpl-2.1|https?://(?:www\.)?gnu\.org/licenses/old-licenses/lgpl-2\.1(?:\.\w+)?
LGPL-3.0-only|80|spdx-license-identifier: lgpl-3.0|spdx-license-identifier: lgpl-3\.0(?:-only)?(?![\w.+-])
LGPL-3.0-or-later|80|spdx-license-identifier: lgpl-3.0|spdx-license-identifier: lgpl-3\.0(?:-or-later|\+)(?![\w.-])
LGPL-3.0-or-later|90|lesser general public license|under the terms of the gnu lesser general public license as published by the free software foundation,? either version 3 of the license, or \(at your option\) any later version
LGPL-3.0|60|lesser general public license|gnu lesser general public license,? (?:version |v\.? ?)3(?:\.0)?
LGPL-3.0|40|lgplv3|(?<!\w)lgplv3\+?(?!\w)
LGPL-3.0|40|lgpl-3.0|(?<![\w.-])lgpl-3\.0(?:-only|-or-later|\+)?(?![\w.-])
LGPL-3.0|70|gnu.org/licenses/lgpl-3.0|https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.\w+)?
LGPL-unversioned|20|lesser general public license|gnu lesser general public license
LGPL-unversioned|20|gnu lgpl|gnu lgpl(?!\w)
AGPL-1.0|80|spdx-license-identifier: agpl-1.0|spdx-license-identifier: agpl-1\.0(?:-only|-or-later)?(?![\w.-])
AGPL-3.0-only|80|spdx-license-identifier: agpl-3.0|spdx-license-identifier: agpl-3\.0(?:-only)?(?![\w.+-])
AGPL-3.0-or-later|80|spdx-license-identifier: agpl-3.0|spdx-license-identifier: agpl-3\.0(?:-or-later|\+)(?![\w.-])
AGPL-3.0-or-later|90|affero general public license|under the terms of the gnu affero general public license as published by the free software foundation,? either version 3 of the license, or \(at your option\) any later version
AGPL-3.0|60|affero general public license|gnu affero general public license,? (?:version |v\.? ?)3(?:\.0)?
AGPL-3.0|40|agplv3|(?<!\w)agplv3\+?(?!\w)
AGPL-3.0|40|agpl-3.0|(?<![\w.-])agpl-3\.0(?:-only|-or-later|\+)?(?![\w.-])
AGPL-3.0|70|gnu.org/licenses/agpl|https?://(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.\w+)?
AGPL-unversioned|20|affero general public license|(?:gnu )?affero general public license
GFDL-1.1|60|free documentation license|gnu free documentation license,? version 1\.1
GFDL-1.2|60|free documentation license|gnu free documentation license,? version 1\.2
GFDL-1.3|60|free documentation license|gnu free documentation license,? version 1\.3
GFDL-1.3|80|spdx-license-identifier: gfdl-1.3|spdx-license-identifier: gfdl-1\.3[\w-]*
GFDL-1.2|80|spdx-license-identifier: gfdl-1.2|spdx-license-identifier: gfdl-1\.2[\w-]*
GFDL-unversioned|70|gnu.org/licenses/fdl|https?://(?:www\.)?gnu\.org/licenses/fdl[\w.-]*
GFDL-unversioned|20|free documentation license|gnu free documentation license
MPL-1.0|60|mozilla public license|mozilla public license,? (?:version |v\.? ?)1\.0
MPL-1.0|80|spdx-license-identifier: mpl-1.0|spdx-license-identifier: mpl-1\.0(?![\w.-])
MPL-1.1|60|mozilla public license|mozilla public license,? (?:version |v\.? ?)1\.1
MPL-1.1|80|spdx-license-identifier: mpl-1.1|spdx-license-identifier: mpl-1\.1(?![\w.-])
MPL-1.1|70|mozilla.org/mpl/mpl-1.1|https?://(?:www\.)?mozilla\.org/mpl/mpl-1\.1[\w.]*
MPL-2.0|90|mozilla public license|this source code form is subject to the terms of the mozilla public license, v\. 2\.0
MPL-2.0|60|mozilla public license|mozilla public license,? (?:version |v\.? ?)2\.0
MPL-2.0|80|spdx-license-identifier: mpl-2.0|spdx-license-identifier: mpl-2\.0(?:-no-copyleft-exception)?(?![\w.-])
MPL-2.0|70|mozilla.org/mpl/2.0|https?://(?:www\.)?mozilla\.org/mpl/2\.0/?
MPL-2.0|70|mozilla.org/en-us/mpl/2.0|https?://(?:www\.)?mozilla\.org/en-us/mpl/2\.0/?
MPL-2.0|40|mpl-2.0|(?<![\w.-])mpl-2\.0(?![\w.-])
MPL-unversioned|20|mozilla public license|mozilla public license
EPL-1.0|60|eclipse public license|eclipse public license(?:,? version|,? v\.?| -v)? ?1\.0
EPL-1.0|80|spdx-license-identifier: epl-1.0|spdx-license-identifier: epl-1\.0(?![\w.-])
EPL-1.0|70|eclipse.org/legal/epl-v10|https?://(?:www\.)?eclipse\.org/legal/epl-v10\.html
EPL-2.0|60|eclipse public license|eclipse public license(?:,? version|,? v\.?| -v)? ?2\.0
EPL-2.0|80|spdx-license-identifier: epl-2.0|spdx-license-identifier: epl-2\.0(?![\w.-])
EPL-2.0|70|eclipse.org/legal/epl-2.0|https?://(?:www\.)?eclipse\.org/legal/epl-2\.0/?
EPL-unversioned|20|eclipse public license|eclipse public license
EDL-1.0|60|eclipse distribution license|eclipse distribution license(?:,? (?:version|v\.?) ?1\.0)?
CDDL-1.0|60|common development and distribution license|common development and distribution license(?: \(cddl\))?,? (?:version |v\.? ?)1\.0
CDDL-1.1|60|common development and distribution license|common development and distribution license(?: \(cddl\))?,? (?:version |v\.? ?)1\.1
CDDL-1.0|80|spdx-license-identifier: cddl-1.0|spdx-license-identifier: cddl-1\.0(?![\w.-])
CDDL-1.1|80|spdx-license-identifier: cddl-1.1|spdx-license-identifier: cddl-1\.1(?![\w.-])
CDDL-unversioned|20|common development and distribution license|common development and distribution license
CPL-1.0|60|common public license|common public license(?:,? (?:version|v\.?) ?1\.0)?
CPL-1.0|80|spdx-license-identifier: cpl-1.0|spdx-license-identifier: cpl-1\.0(?![\w.-])
IPL-1.0|60|ibm public license|ibm public license(?:,? (?:version|v\.?) ?1\.0)?
CPAL-1.0|60|common public attribution license|common public attribution license(?:,? (?:version|v\.?) ?1\.0)?
EUPL-1.0|80|spdx-license-identifier: eupl-1.0|spdx-license-identifier: eupl-1\.0(?![\w.-])
EUPL-1.1|80|spdx-license-identifier: eupl-1.1|spdx-license-identifier: eupl-1\.1(?![\w.-])
EUPL-1.2|80|spdx-license-identifier: eupl-1.2|spdx-license-identifier: eupl-1\.2(?![\w.-])
EUPL-1.1|60|european union public licen|european union public licen[cs]e(?: \(eupl\))?,? (?:version |v\.? ?)1\.1
EUPL-1.2|60|european union public licen|european union public licen[cs]e(?: \(eupl\))?,? (?:version |v\.? ?)1\.2
EUPL-unversioned|20|european union public licen|european union public licen[cs]e
CECILL-2.1|60|cecill|cecill(?: free software)? license(?: agreement)?,? version 2\.1
CECILL-2.1|80|spdx-license-identifier: cecill-2.1|spdx-license-identifier: cecill-2\.1(?![\w.-])
CECILL-B|60|cecill-b|(?<!\w)cecill-b(?!\w)
CECILL-C|60|cecill-c|(?<!\w)cecill-c(?!\w)
CECILL-unversioned|20|cecill|(?<!\w)cecill(?![\w-])
CC0-1.0|80|spdx-license-identifier: cc0-1.0|spdx-license-identifier: cc0-1\.0(?![\w.-])
CC0-1.0|70|creativecommons.org/publicdomain/zero/1.0|https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0(?:/[\w.-]*)*
CC0-1.0|60|cc0 1.0|cc0 1\.0(?: universal)?(?: \(cc0 1\.0\))?(?: public domain dedication)?
CC0-1.0|40|cc0|(?<![\w.-])cc0(?:-1\.0)?(?![\w.-])
CC-PDDC|70|creativecommons.org/licenses/publicdomain|https?://(?:www\.)?creativecommons\.org/licenses/publicdomain/?
CC-PDM-1.0|70|creativecommons.org/publicdomain/mark/1.0|https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
CC-BY-1.0|70|creativecommons.org/licenses/by/1.0|https?://(?:www\.)?creativecommons\.org/licenses/by/1\.0/?
CC-BY-2.0|70|creativecommons.org/licenses/by/2.0|https?://(?:www\.)?creativecommons\.org/licenses/by/2\.0/?
CC-BY-2.5|70|creativecommons.org/licenses/by/2.5|https?://(?:www\.)?creativecommons\.org/licenses/by/2\.5/?
CC-BY-3.0|70|creativecommons.org/licenses/by/3.0|https?://(?:www\.)?creativecommons\.org/licenses/by/3\.0/?
CC-BY-4.0|70|creativecommons.org/licenses/by/4.0|https?://(?:www\.)?creativecommons\.org/licenses/by/4\.0/?
CC-BY-SA-2.0|70|creativecommons.org/licenses/by-sa/2.0|https?://(?:www\.)?creativecommons\.org/licenses/by-sa/2\.0/?
CC-BY-SA-2.5|70|creativecommons.org/licenses/by-sa/2.5|https?://(?:www\.)?creativecommons\.org/licenses/by-sa/2\.5/?
CC-BY-SA-3.0|70|creativecommons.org/licenses/by-sa/3.0|https?://(?:www\.)?creativecommons\.org/licenses/by-sa/3\.0/?
CC-BY-SA-4.0|70|creativecommons.org/licenses/by-sa/4.0|https?://(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0/?
CC-BY-NC-2.0|70|creativecommons.org/licenses/by-nc/2.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nc/2\.0/?
CC-BY-NC-3.0|70|creativecommons.org/licenses/by-nc/3.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nc/3\.0/?
CC-BY-NC-4.0|70|creativecommons.org/licenses/by-nc/4.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0/?
CC-BY-NC-SA-3.0|70|creativecommons.org/licenses/by-nc-sa/3.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/3\.0/?
CC-BY-NC-SA-4.0|70|creativecommons.org/licenses/by-nc-sa/4.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-NC-ND-3.0|70|creativecommons.org/licenses/by-nc-nd/3.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/3\.0/?
CC-BY-NC-ND-4.0|70|creativecommons.org/licenses/by-nc-nd/4.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC-BY-ND-3.0|70|creativecommons.org/licenses/by-nd/3.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nd/3\.0/?
CC-BY-ND-4.0|70|creativecommons.org/licenses/by-nd/4.0|https?://(?:www\.)?creativecommons\.org/licenses/by-nd/4\.0/?
CC-BY-3.0|60|cc by 3.0|(?<!\w)cc by 3\.0
CC-BY-4.0|60|cc by 4.0|(?<!\w)cc by 4\.0
CC-BY-SA-3.0|60|cc by-sa 3.0|(?<!\w)cc by-sa 3\.0
CC-BY-SA-4.0|60|cc by-sa 4.0|(?<!\w)cc by-sa 4\.0
CC-BY-NC-4.0|60|cc by-nc 4.0|(?<!\w)cc by-nc 4\.0
CC-BY-NC-SA-4.0|60|cc by-nc-sa 4.0|(?<!\w)cc by-nc-sa 4\.0
CC-BY-NC-ND-4.0|60|cc by-nc-nd 4.0|(?<!\w)cc by-nc-nd 4\.0
CC-BY-ND-4.0|60|cc by-nd 4.0|(?<!\w)cc by-nd 4\.0
CC-BY-3.0|40|cc-by-3.0|(?<![\w.-])cc-by-3\.0(?![\w.-])
CC-BY-4.0|40|cc-by-4.0|(?<![\w.-])cc-by-4\.0(?![\w.-])
CC-BY-SA-3.0|40|cc-by-sa-3.0|(?<![\w.-])cc-by-sa-3\.0(?![\w.-])
CC-BY-SA-4.0|40|cc-by-sa-4.0|(?<![\w.-])cc-by-sa-4\.0(?![\w.-])
CC-BY-NC-4.0|40|cc-by-nc-4.0|(?<![\w.-])cc-by-nc-4\.0(?![\w.-])
CC-BY-4.0|60|creative commons attribution 4.0|creative commons attribution 4\.0(?: international)?(?: (?:public )?license)?
CC-BY-3.0|60|creative commons attribution 3.0|creative commons attribution 3\.0(?: unported)?(?: license)?
CC-BY-SA-4.0|60|creative commons attribution-sharealike 4.0|creative commons attribution-sharealike 4\.0(?: international)?(?: (?:public )?license)?
CC-BY-SA-3.0|60|creative commons attribution-sharealike 3.0|creative commons attribution-sharealike 3\.0(?: unported)?(?: license)?
CC-BY-NC-4.0|60|creative commons attribution-noncommercial 4.0|creative commons attribution-noncommercial 4\.0(?: international)?(?: (?:public )?license)?
CC-BY-NC-SA-4.0|60|creative commons attribution-noncommercial-sharealike 4.0|creative commons attribution-noncommercial-sharealike 4\.0(?: international)?(?: (?:public )?license)?
CC-BY-NC-ND-4.0|60|creative commons attribution-noncommercial-noderivatives 4.0|creative commons attribution-noncommercial-noderivatives 4\.0(?: international)?(?: (?:public )?license)?
CC-BY-ND-4.0|60|creative commons attribution-noderivatives 4.0|creative commons attribution-noderivatives 4\.0(?: international)?(?: (?:public )?license)?
CC-unversioned|20|creative commons attribution|creative commons attribution(?:-(?:noncommercial|sharealike|noderivatives|noderivs))*
CC-unversioned|20|creative commons license|creative commons license
CC-unversioned|20|creative commons licence|creative commons licence
Unlicense|90|this is free and unencumbered software|this is free and unencumbered software released into the public domain
Unlicense|80|spdx-license-identifier: unlicense|spdx-license-identifier: unlicense(?![\w.-])
Unlicense|70|unlicense.org|https?://(?:www\.)?unlicense\.org/?
Unlicense|40|the unlicense|the unlicense
Public-Domain|60|public domain|(?:released|placed|dedicated|is) (?:in|into|to) the public domain
Public-Domain|20|public domain|public domain
WTFPL|90|do what the fuck you want to|do what the fuck you want to public license
WTFPL|80|spdx-license-identifier: wtfpl|spdx-license-identifier: wtfpl(?![\w.-])
WTFPL|40|wtfpl|(?<!\w)wtfpl(?!\w)
Zlib|90|this software is provided 'as-is'|this software is provided 'as-is', without any express or implied warranty
Zlib|80|spdx-license-identifier: zlib|spdx-license-identifier: zlib(?![\w.-])
Zlib|60|zlib license|zlib license
Zlib|60|zlib/libpng license|zlib/libpng license
libpng|60|libpng license|libpng license
BSL-1.0|90|boost software license|distributed under the boost software license,? version 1\.0
BSL-1.0|80|spdx-license-identifier: bsl-1.0|spdx-license-identifier: bsl-1\.0(?![\w.-])
BSL-1.0|70|boost.org/license_1_0.txt|https?://(?:www\.)?boost\.org/license_1_0\.txt
BSL-1.0|60|boost software license|boost software license(?:,? version 1\.0)?
Artistic-1.0|80|spdx-license-identifier: artistic-1.0|spdx-license-identifier: artistic-1\.0(?:-perl|-cl8)?(?![\w.-])
Artistic-1.0|60|artistic license|artistic license,? (?:version )?1\.0
Artistic-2.0|80|spdx-license-identifier: artistic-2.0|spdx-license-identifier: artistic-2\.0(?![\w.-])
Artistic-2.0|60|artistic license|artistic license,? (?:version )?2\.0
Artistic-unversioned|20|artistic license|artistic license
Perl-dual|60|same terms as perl itself|same terms as perl itself
PSF-2.0|60|python software foundation license|python software foundation license(?:,? version 2)?
PSF-2.0|60|psf license|psf license
PSF-2.0|80|spdx-license-identifier: psf-2.0|spdx-license-identifier: psf-2\.0(?![\w.-])
Python-2.0|80|spdx-license-identifier: python-2.0|spdx-license-identifier: python-2\.0(?![\w.-])
Ruby|60|same terms as ruby|same terms as ruby
Ruby|80|spdx-license-identifier: ruby|spdx-license-identifier: ruby(?![\w.-])
PHP-3.01|60|php license|php license,? (?:version )?3\.01
PHP-3.0|60|php license|php license,? (?:version )?3\.0(?!1)
PHP-unversioned|20|php license|php license
Ms-PL|60|microsoft public license|microsoft public license(?: \(ms-pl\))?
Ms-PL|80|spdx-license-identifier: ms-pl|spdx-license-identifier: ms-pl(?![\w.-])
Ms-RL|60|microsoft reciprocal license|microsoft reciprocal license(?: \(ms-rl\))?
Ms-RL|80|spdx-license-identifier: ms-rl|spdx-license-identifier: ms-rl(?![\w.-])
OFL-1.1|60|sil open font license|sil open font license(?:,? (?:version |v\.? ?)1\.1)?
OFL-1.1|80|spdx-license-identifier: ofl-1.1|spdx-license-identifier: ofl-1\.1(?:-rfn|-no-rfn)?(?![\w.-])
OFL-1.1|70|scripts.sil.org/ofl|https?://scripts\.sil\.org/ofl
OSL-3.0|60|open software license|open software license,? (?:version |v\.? ?)3\.0
OSL-3.0|80|spdx-license-identifier: osl-3.0|spdx-license-identifier: osl-3\.0(?![\w.-])
OSL-2.1|60|open software license|open software license,? (?:version |v\.? ?)2\.1
AFL-3.0|60|academic free license|academic free license,? (?:version |v\.? ?)3\.0
AFL-3.0|80|spdx-license-identifier: afl-3.0|spdx-license-identifier: afl-3\.0(?![\w.-])
AFL-2.1|60|academic free license|academic free license,? (?:version |v\.? ?)2\.1
AFL-unversioned|20|academic free license|academic free license
ECL-2.0|60|educational community license|educational community license(?:,? version 2\.0)?
ECL-2.0|80|spdx-license-identifier: ecl-2.0|spdx-license-identifier: ecl-2\.0(?![\w.-])
NCSA|60|university of illinois/ncsa open source license|university of illinois/ncsa open source license
NCSA|80|spdx-license-identifier: ncsa|spdx-license-identifier: ncsa(?![\w.-])
UPL-1.0|60|universal permissive license|universal permissive license(?: \(upl\))?(?:,? (?:version|v\.?) ?1\.0)?
UPL-1.0|80|spdx-license-identifier: upl-1.0|spdx-license-identifier: upl-1\.0(?![\w.-])
BlueOak-1.0.0|60|blue oak model license|blue oak model license(?: 1\.0\.0)?
BlueOak-1.0.0|80|spdx-license-identifier: blueoak-1.0.0|spdx-license-identifier: blueoak-1\.0\.0(?![\w.-])
MulanPSL-2.0|60|mulan psl v2|mulan psl v2
MulanPSL-2.0|80|spdx-license-identifier: mulanpsl-2.0|spdx-license-identifier: mulanpsl-2\.0(?![\w.-])
ODbL-1.0|60|open database license|open (?:data commons open )?database license(?: \(odbl\))?(?:,? (?:version |v\.? ?)1\.0)?
ODbL-1.0|80|spdx-license-identifier: odbl-1.0|spdx-license-identifier: odbl-1\.0(?![\w.-])
ODbL-1.0|70|opendatacommons.org/licenses/odbl|https?://(?:www\.)?opendatacommons\.org/licenses/odbl[\w/.-]*
ODC-By-1.0|60|open data commons attribution license|open data commons attribution license(?:,? v?1\.0)?
ODC-By-1.0|70|opendatacommons.org/licenses/by|https?://(?:www\.)?opendatacommons\.org/licenses/by[\w/.-]*
PDDL-1.0|60|public domain dedication and license|(?:open data commons )?public domain dedication and license(?: \(pddl\))?
PDDL-1.0|70|opendatacommons.org/licenses/pddl|https?://(?:www\.)?opendatacommons\.org/licenses/pddl[\w/.-]*
OGL-UK-3.0|60|open government licence v3.0|open government licence v3\.0
OGL-UK-2.0|60|open government licence v2.0|open government licence v2\.0
OGL-unversioned|20|open government licence|open government licence
CDLA-Permissive-1.0|60|community data license agreement|community data license agreement (?:-|–) permissive(?:,? version 1\.0)?
CDLA-Permissive-2.0|80|spdx-license-identifier: cdla-permissive-2.0|spdx-license-identifier: cdla-permissive-2\.0(?![\w.-])
CDLA-Sharing-1.0|60|community data license agreement|community data license agreement (?:-|–) sharing(?:,? version 1\.0)?
SSPL-1.0|60|server side public license|server side public license(?:,? (?:version|v\.?) ?1)?
SSPL-1.0|80|spdx-license-identifier: sspl-1.0|spdx-license-identifier: sspl-1\.0(?![\w.-])
BUSL-1.1|60|business source license|business source license(?: 1\.1)?
BUSL-1.1|80|spdx-license-identifier: busl-1.1|spdx-license-identifier: busl-1\.1(?![\w.-])
Elastic-2.0|60|elastic license|elastic license(?:,? (?:version )?2\.0)?
Elastic-2.0|80|spdx-license-identifier: elastic-2.0|spdx-license-identifier: elastic-2\.0(?![\w.-])
Commons-Clause|60|commons clause|"?commons clause"?(?: license condition v1\.0)?
PolyForm-NC-1.0|60|polyform noncommercial license|polyform noncommercial license(?: 1\.0\.0)?
PolyForm-SB-1.0|60|polyform small business license|polyform small business license(?: 1\.0\.0)?
OpenRAIL-M|60|rail -m|(?:creativeml |bigscience )?(?:open ?rail(?:\+\+)?-m)(?: license)?
RAIL|40|responsible ai license|(?:bigscience )?responsible ai license
Llama-Community|60|community license agreement|llama \d(?:\.\d)? community license agreement
OpenSSL|60|openssl license|openssl license
OpenSSL|80|spdx-license-identifier: openssl|spdx-license-identifier: openssl(?![\w.-])
SSLeay|60|original ssleay license|original ssleay license
ICU|60|icu license|icu license
ICU|80|spdx-license-identifier: icu|spdx-license-identifier: icu(?![\w.-])
Unicode-DFS|60|unicode license agreement|unicode license agreement
Unicode-DFS|80|spdx-license-identifier: unicode-dfs|spdx-license-identifier: unicode-dfs-201[56](?![\w.-])
W3C|60|w3c software notice and license|w3c software notice and license
W3C|80|spdx-license-identifier: w3c|spdx-license-identifier: w3c(?:-\d+)?(?![\w.-])
curl|80|spdx-license-identifier: curl|spdx-license-identifier: curl(?![\w.-])
Vim|80|spdx-license-identifier: vim|spdx-license-identifier: vim(?![\w.-])
Beerware|90|the beer-ware license|"?the beer-ware license"?
TCL|80|spdx-license-identifier: tcl|spdx-license-identifier: tcl(?![\w.-])
FTL|60|freetype license|(?:the )?freetype license
FTL|80|spdx-license-identifier: ftl|spdx-license-identifier: ftl(?![\w.-])
LPPL-1.3c|60|latex project public license|latex project public license(?:,? (?:version|v\.?) ?1\.3c?)?
LPPL-1.3c|80|spdx-license-identifier: lppl-1.3|spdx-license-identifier: lppl-1\.3[ac](?![\w.-])
QPL-1.0|60|q public license|(?<!\w)q public license(?: version 1\.0)?
Sleepycat|60|sleepycat license|sleepycat license
SISSL|60|sun industry standards source license|sun industry standards source license
PostgreSQL|60|postgresql licen|postgresql licen[cs]e
PostgreSQL|80|spdx-license-identifier: postgresql|spdx-license-identifier: postgresql(?![\w.-])
Proprietary|60|all rights reserved|unauthorized (?:copying|reproduction|distribution|use)[^.]{0,120}is (?:strictly )?prohibited[^.]{0,40}\. [^.]{0,80}all rights reserved
Proprietary|60|proprietary and confidential|proprietary and confidential
Proprietary|60|confidential and proprietary|confidential and proprietary
Proprietary|60|without express written permission|(?:reproduc|distribut|copi|us)ed? [^.]{0,80}without express written permission
Proprietary|60|prior written consent|(?:reproduc|distribut|copi|us|disclos)ed? [^.]{0,80}prior written consent
Proprietary|40|all rights reserved|all rights reserved
Copyright-notice|40|copyright|copyright (?:\(c\)|©) \d{4}(?:[-–, ]+\d{4})*
Copyright-notice|20|copyright|copyright \d{4}(?:[-–, ]+\d{4})*
Copyright-notice|20|(c) copyright|\(c\) copyright(?: \d{4})?
License-reference|20|spdx-license-identifier|spdx-license-identifier: [\w.+()-]+(?: (?:and|or|with) [\w.+()-]+)*
License-reference|20|see the license file|see the license file
License-reference|20|license terms|license terms
License-reference|20|licensed under|licensed under (?:the |a )?(?:terms of )?[\w.-]+(?: [\w.-]+){0,3}
License-reference|20|licensed to the|licensed to the [\w.-]+(?: [\w.-]+){0,4} under one or more contributor license agreements
"""
