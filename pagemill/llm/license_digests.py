"""Digests of the canonical forms of long licences, as published (``licenses.canonical_text``).

Made from the texts in Debian's common-licenses, the SPDX texts that come with Rust, and
a crate's UNLICENSE: with and without what follows the terms, with http and https
addresses, the postal addresses of the Free Software Foundation, and without copyright
statements.
"""

DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "0bd92ecab6c9ae6d797ceea4eaf189857999b290b26b0da8e9dc0ff3c30a34e8",
        "3cadc7d4f362979643c5bb255c4c9d67312a93c3c4af0667dd141c2b18817454",
        "6537484b35791c1a5da5423a0ec37a0b53cf576633f99dbc6cbbc082d0cd8d66",
        "7344d7b010ed06669d02fd695b0ad14b4f233520668c35c46d585f981ed64e02",
        "8ab25d713641c4b0ebccdc1c14ffc6fcf46332ee1f3e9b44b38325000ffb3b0b",
        "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801",
        "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0",
        "bb531182159142b308d308fe34391e6848d93f2a2ed991087b686ec75f9dbb1d",
        "c348fad4100086120c9a4f71602579f6f49d5ca97ae96d36cf377b10e6e79871",
        "c46dfd45ed4a19fe4a99eaed08590a0c093e3a0b73c293ece466f468b902aff3",
        "c936c3be4c0e23ce771b851922c44c2c6bbb0fb8c42f59ae99cf57ebd223697c",
        "ef3211463b904cb61f1da41dbb54ffd6b734df8875b1247dc5553607e160be35",
    ],
    "CC0-1.0": [
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ],
    "CC-BY-SA-4.0": [
        "49259de2e41746a2de3ac8abe98d6effcc752e1bb462ce8dae8c86b9d34d94bc",
        "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d",
    ],
    "GFDL-1.2": [
        "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
        "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    ],
    "GFDL-1.3": [
        "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
        "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    ],
    "GPL-1.0": [
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "6b8aa061ab2468f72680f44d91b7b093a92b1f5b12af8a9ff0e0efa0f1ad9d32",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "d3f2fd6ccabfae9813d009b1230c846c9d2184c61967399bebf30901e2c80155",
    ],
    "GPL-2.0": [
        "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50",
        "1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a",
        "204354f4ce2c7d402ca9ad1c08c91b4301b495a0769207c9817a1e1536f3dab2",
        "2d5106d375402f83b041785ad1b9925ed45196d448c7db5889cf8d50aece384b",
        "2dddfb21baee920dbbc3d75228da3d2104eb54e673ef5f867ab4495e23c974fc",
        "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "765649880cdff92fe5ac36da2f80c5d70533878beda24dba289f983bd3913453",
        "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25",
        "8c1c2994cc30a83607e645d0c7bfe94908618dbc8797ce927cf2fe8ebf674752",
        "9bd057847abcffd3f15185fad140e3672c126a542d4849381ab82e33384d56a1",
        "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75",
        "acaf68e303fe7610fff5b930bace57b87821d132bc434f4a104512da48f8bb6c",
        "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774",
        "ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd",
        "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    ],
    "GPL-3.0": [
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "0d3bfcceda6470dcd13089cae938e4e0251be32d7ab34ca76aea6195a56230bf",
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ],
    "LGPL-2.0": [
        "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318",
        "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108",
        "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1",
        "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380",
    ],
    "LGPL-2.1": [
        "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87",
        "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb",
        "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47",
        "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
        "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354",
    ],
    "MPL-2.0": [
        "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b",
        "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56",
    ],
    "OFL-1.1": [
        "a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a",
    ],
    "Unlicense": [
        "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd",
        "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff",
    ],
}
