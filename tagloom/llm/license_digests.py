"""SHA-256 of known licence texts after :func:`licenses.canonical`, by SPDX name.

Texts as published (with and without what follows the end of the terms, and with the
earlier address of the Free Software Foundation); a test looks up the common ones where the
texts are installed.
"""

DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("EPL-2.0", "3f0940832a6ad2bb0c8e9f8a8b3fad4427b43e6b2a7110ce5f8c4b1420f8804c"),
    ("EPL-2.0", "8fbb910251c24acd487b634ceb37457ff21d40aef11bed21e8bfa194397787e9"),
    ("GFDL-1.2", "915561db8eb69b9193eeb710593d298365e0c52787feb731c684977d5b417af7"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "98c96304603be152968c123e484f744c9b51ebd341914aee6eea5c39133891e1"),
    ("GPL-1.0", "9b80eb3145b87968fde482b384ff47a39c81a9f3f04b7b569a2876c47d7ebdf8"),
    ("GPL-1.0", "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697"),
    ("GPL-2.0", "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25"),
    ("GPL-2.0", "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "670e75cc2d7d4bec40833b2ff3da80b59d9599b098ec4fb0811fbdd53d4b7e3d"),
    ("GPL-3.0", "8219c96910d0b89921ad79ea880af2dab0ae29ea290968138c8358b18b69cff6"),
    ("GPL-3.0", "a700ef9a30824c85306cfff3b2fbfc67435cfef60233323af5131b7a8dc1ab48"),
    ("LGPL-2.0", "54a6c3821aef50c4ea766df5c9d96a2034836ea458ad32d4d67fd58efd3ea7ec"),
    ("LGPL-2.0", "66b4416fed722b119c08a4c93164fe7e4393904ddfebd70b7c5d67f55c9c341b"),
    ("LGPL-2.0", "86bb0e384210bb06f082b31b30656d95754ce8f17e2a7f274d05687a80b98b88"),
    ("LGPL-2.0", "c748d4db5563e5d8bbbcabb73c3c92b8cc2ffc85d217826426957554802b66e6"),
    ("LGPL-2.0", "dcaf6a1d946eda38aa3e5348e17092393dc9ce2648ac9b83fe1013198984cb37"),
    ("LGPL-2.0", "ef41ee09d8aa8771b7e357e916630e2a3c47e12518e13badeab697b8caa28812"),
    ("LGPL-2.1", "15bedfcfc5e050b8849fab4d015767f2a32733b79a76910bfadf80cf534c068d"),
    ("LGPL-2.1", "651c34f3244a526ba2541f9d69d4ed35e3d889ba59c8c58d7197b0922210effb"),
    ("LGPL-2.1", "827c0ba8dd815a7441fe91c3331b2098760cc0b9e11f7918bfab0f8188c45b56"),
    ("LGPL-2.1", "ad6d7d0a719230f49d72e1d93f47f70d48c06ede8f652bd75cda5e20f209bc88"),
    ("LGPL-2.1", "c03f5ef4b5df9eba007631768d6cfe6e97bb62ac75ca1993fd5435fcbe23319c"),
    ("LGPL-2.1", "f920b7f157c3c3764246eab6e78c087f9a160d61050b2eb4c717003890a2d562"),
    ("LGPL-3.0", "3ede7494a82fe6f9c1d0a28646ae309d51b9cc301b39d60d0de3be5c1869bd38"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
