"""Known licence sentences and the rules made of them."""

# Sentences of public licence texts, headers and notices. Identifier, sentence.
SENTENCES = [
    ("all-rights", "All rights reserved"),
    # MIT, X11, ISC, 0BSD
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "This project is licensed under the MIT License"),
    ("mit-notice", "This software is released under the MIT License"),
    ("mit-notice", "Use of this source code is governed by an MIT-style license"),
    ("mit-title", "The MIT License"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-0-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("x11-advertising", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    # Apache
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-notice", "Released under the Apache License, Version 2.0"),
    ("apache-notice", "This project is licensed under the Apache License 2.0"),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-asf", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    ("apache-obey", "you may not use this file except in compliance with the License"),
    ("apache-obtain", "You may obtain a copy of the License at"),
    ("apache-disclaimer", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("apache-grant", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    # BSD
    ("bsd-notice", "Use of this source code is governed by a BSD-style license"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("bsd-liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    # GPL, LGPL, AGPL
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-notice", "Licensed under the GNU General Public License, version 3"),
    ("gpl2-notice", "Licensed under the GNU General Public License, version 2"),
    ("gpl2-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl2-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl-copy", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("lgpl-copy", "You should have received a copy of the GNU Lesser General Public License along with this program"),
    ("agpl-copy", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("gpl-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    # Mozilla, Eclipse, Boost, zlib, others
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("epl2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at"),
    ("epl1-notice", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("postgresql-grant", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ofl-notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("artistic-notice", "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself"),
    # Creative Commons, public domain
    ("by-notice", "Licensed under CC BY 4.0"),
    ("by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("by-notice", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("by3-notice", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"),
    ("by-sa-notice", "Licensed under CC BY-SA 4.0"),
    ("by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("by-sa3-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("by-nd-notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("by-nc-sa-notice", "Licensed under CC BY-NC-SA 4.0"),
    ("by-nc-sa-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("by-nc-nd-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0-notice", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc0-notice", "Licensed under CC0 1.0 Universal"),
    ("cc0-title", "CC0 1.0 Universal"),
    ("cc0-warranty", "This software is distributed without any warranty"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]

# In this order; a sequence matches where its identifiers follow each other among a document's known sentences.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "as-is", "mit-liability"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "as-is"]),
    ("X11", ["mit-grant", "mit-condition", "as-is", "mit-liability", "x11-advertising"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT-0", ["mit-0-grant", "as-is"]),
    ("ISC", ["isc-grant", "isc-disclaimer"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-disclaimer"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-notice"]),
    ("Apache-2.0", ["apache-asf", "apache-obey", "apache-obtain", "apache-disclaimer", "apache-see"]),
    ("Apache-2.0", ["apache-notice", "apache-obey", "apache-obtain", "apache-disclaimer", "apache-see"]),
    ("Apache-2.0", ["apache-notice", "apache-obey", "apache-obtain"]),
    ("Apache-2.0", ["apache-title", "apache-grant"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-title"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-copy"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-copy"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-copy"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-2.0-or-later", ["lgpl2-free"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EPL-1.0", ["epl1-notice"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("WTFPL", ["wtfpl"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ["artistic-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("CC-BY-4.0", ["by-notice"]),
    ("CC-BY-3.0", ["by3-notice"]),
    ("CC-BY-SA-4.0", ["by-sa-notice"]),
    ("CC-BY-SA-3.0", ["by-sa3-notice"]),
    ("CC-BY-ND-4.0", ["by-nd-notice"]),
    ("CC-BY-NC-4.0", ["by-nc-notice"]),
    ("CC-BY-NC-SA-4.0", ["by-nc-sa-notice"]),
    ("CC-BY-NC-ND-4.0", ["by-nc-nd-notice"]),
    ("CC0-1.0", ["cc0-title", "cc0-notice"]),
    ("CC0-1.0", ["cc0-notice", "cc0-warranty"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-title"]),
    ("Unlicense", ["public-domain", "unlicense-grant"]),
    ("Unlicense", ["public-domain"]),
    ("all-rights-reserved", ["all-rights"]),
]
