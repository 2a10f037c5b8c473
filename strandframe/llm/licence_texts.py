"""Texts that licence scans learn from. All are fixed values."""

from __future__ import annotations

# Notices of well-known licences, by family. Case and punctuation don't count.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "MIT License",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
        "Released under the GNU LGPL version 3.",
        "GNU Lesser General Public License Version 3",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the GNU AGPL version 3.",
    ),
    "bsd": (
        "BSD License",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        "Released under the MPL 2.0.",
        "Mozilla Public License Version 2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.",
        "You are free to share and adapt the material for any purpose, even commercially, under the following term: Attribution. You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "ShareAlike. If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "NonCommercial. You may not use the material for commercial purposes.",
        "This article is distributed under the terms of the Creative Commons Attribution-NonCommercial License, which permits non-commercial use, provided the original work is properly cited.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
# Notices of licences that are no family here, and plain sentences.
UNKNOWN = (
    "All rights reserved. No part may be reproduced without written permission of the publisher.",
    "Use of this material is subject to the terms of a separate license agreement.",
    "Licensed under the terms of the vendor's proprietary license.",
    "Released under the Example Community License.",
    "This software is provided under a commercial license.",
    "Licensed to the customer for internal use only.",
    "Distributed under its own license, see the file for details.",
    "This work is licensed under a custom license, version 1.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, all subject to the following.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Licensed under the Educational Community License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Licensed under the Open Software License version 3.0.",
    "Licensed under the Academic Free License version 2.1.",
    "The contents of this file are subject to the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "This program and the accompanying materials are made available under the terms of the Common Public License v1.0 which accompanies this distribution.",
    "Microsoft Public License (Ms-PL). If you use the software, you accept this license. If you do not accept the license, do not use the software.",
    "IBM Public License Version 1.0",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: Artistic-2.0",
    "Released under the Artistic License 2.0.",
    "Released under the Python Software Foundation License.",
    "PostgreSQL License",
    "zlib License",
    "Vim License",
    "NCSA License",
    "The Artistic License 2.0",
    "Boost Software License",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: CDDL-1.0",
    "SPDX-License-Identifier: OSL-3.0",
    "SPDX-License-Identifier: ECL-2.0",
    "SPDX-License-Identifier: NCSA",
    "SPDX-License-Identifier: OFL-1.1",
    "Do What The Fuck You Want To Public License, Version 2",
    "By installing the software you accept the terms of this end user license agreement. You may not copy, rent, lease or sublicense the software.",
    "Copyright the publisher. All rights reserved.",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.",
)
PLAIN = (
    "The weather was fine and we walked along the river for an hour.",
    "He used the work of the person who came before him.",
    "It is a matter of time and of the right conditions.",
    "The files are in the folder, and any copy of them will do.",
    "A general of the army met the public at the gate.",
    "We can use it and modify the plan at any later time.",
    "She published a version of the story in the city paper.",
    "The driving license expired and the police kept a copy.",
    "This program on the radio is free for any person.",
    "By the terms of the game you may not move twice.",
    "The source of the river is in the mountains to the north.",
    "You should have received the letter along with the book.",
    "And the of to in that for it was on with as at by from this is are be.",
    "The rights of the people and the use of the land were discussed.",
    "The software crashed, so we use another version and copy the files by hand.",
    "Public law in general is a subject that any student may take free of charge.",
    "The license plate of the car was covered with mud.",
    "Version 2 of the document is out, and version 3 will follow in May.",
    "Share the source of your joy with a friend and be kind.",
    "The author gave credit to the original work of the painter.",
    "The commercial break was long and the material of the show was thin.",
    "Under the terms of the treaty the land was returned to the north.",
    "An attribution of the painting to the school is uncertain.",
    "The university of Berkeley and the institute in Massachusetts published a study.",
    "A common mistake is to open the box without reading the notice.",
    "Apache helicopters flew over the town, said the army.",
    "Leaflets were distributed to the public under the conditions that the mayor had named.",
    "The film was released in May, and the general public may see it without charge.",
    "A licensed guide is provided for the tour of the works.",
    "Redistribution of land was a common theme of the program.",
    "Sie ging mit dem Hund durch den Wald und kam mit dem Rad nach Hause.",
    "Er war mit der Arbeit nicht zufrieden, aber die Freunde kamen mit ihm.",
    "Wir sprachen mit den Nachbarn über das Wetter und die Stadt.",
    "Nous avons un permis et la source est dans la montagne.",
    "Le public a vu le film dans la ville, et la version est libre.",
    "El general y la gente de la ciudad hablaron con el autor del libro.",
    "La casa no tiene permiso, y las partes van a la oficina.",
    "Il testo e la copia sono nella casa del signore.",
    "She studied at MIT and he moved to the coast.",
    "In chapter 1 there is an example, and table 2 shows 3 more.",
    "Write to the office at info@example.org or see www.example.org for version 4 of the list.",
    "Call 0 555 1 2 3 4 only if the work is urgent.",
)
# Other wordings, on which probabilities are calibrated; nothing is trained on them.
HELD = (
    ("mit", "Distributed under the MIT license, see LICENSE."),
    ("mit", "The code in this repository is made available under the terms of the MIT License (MIT)."),
    ("apache", "This module is released under the terms of the Apache License 2.0, see the LICENSE file."),
    ("apache", "Apache License Version 2.0, January 2004"),
    ("gpl", "You may copy this file under the GNU GPL, version 2 or later."),
    ("gpl", "Distributed under the terms of the GNU General Public License v2."),
    ("lgpl", "This module may be used under the GNU Lesser General Public License, version 3."),
    ("agpl", "The server is published under the GNU Affero General Public License v3."),
    ("bsd", "Use is subject to the BSD license, 3 clauses."),
    ("bsd", "Distributed under the terms of the Modified BSD License."),
    ("mpl", "Distributed under the terms of the Mozilla Public License 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-1.1"),
    ("cc-by", "Text and pictures are under CC BY 4.0 unless noted."),
    ("cc-by-sa", "The pictures are available under CC BY-SA 3.0."),
    ("cc-by-nc", "Figures may be reused under CC BY-NC 4.0."),
    ("cc0", "The data are in the public domain (CC0 1.0)."),
    ("unknown", "Distributed under the Artistic License."),
    ("unknown", "The library comes under the Boost license."),
    ("unknown", "Made available under the Common Public License, see below."),
    ("unknown", "Contact the vendor for a license before you use the software."),
    ("unknown", "The zlib license applies to this file."),
    ("none", "He may copy the letter at any time and sell the house."),
    ("none", "The public was free to use the park under the bridge."),
    ("none", "The general made a program for the work in the city."),
    ("none", "Conditions on the road were bad, and the source of the trouble was the ice."),
    ("none", "The notice said that the software of the clock would be replaced."),
)
# Words that say nothing by themselves.
COMMON = frozenset(
    "a all an and any are as at be but by can do for from had has have he her him his if in into is it its may more must no not of on or other out over shall she should so some such that the their them they this to under up upon was we were what when where which who will with would you your".split()
)
