"""Published results that the library must give again. Pairs: video, speaker, words, numbers of the clips, and their seconds; review: places of the sample's pairs among them, in order."""

PAIRS = {
    "padded_overlap_v3": [
        ("JPqiY3AA8EM_part001", "spk16", "может", "чтобы", 187, 188, "102.233", "103.433", "103.267", "104.267", 0.166, 0.166),
        ("JPqiY3AA8EM_part001", "spk16", "значит", "есть", 357, 358, "188.0", "189.2", "188.5", "189.467", 0.7, 0.723888),
        ("JPqiY3AA8EM_part001", "spk16", "значит", "есть", 362, 363, "190.167", "191.233", "190.533", "191.6", 0.7, 0.65666),
        ("JPqiY3AA8EM_part001", "spk16", "значит", "есть", 368, 369, "193.567", "194.7", "194.0", "194.967", 0.7, 0.723888),
        ("JPqiY3AA8EM_part003", "spk16", "есть", "когда", 278, 279, "135.7", "136.567", "135.867", "137.167", 0.7, 0.807382),
        ("JPqiY3AA8EM_part004", "spk16", "когда", "есть", 44, 46, "23.833", "24.833", "24.367", "25.3", 0.466, 0.499464),
        ("JPqiY3AA8EM_part004", "spk16", "когда", "чтобы", 413, 416, "212.0", "212.967", "212.7", "213.7", 0.267, 0.276112),
        ("JPqiY3AA8EM_part004", "spk16", "когда", "есть", 464, 465, "235.4", "236.6", "236.267", "237.233", 0.333, 0.34472),
        ("JPqiY3AA8EM_part004", "spk16", "есть", "просто", 586, 588, "295.833", "296.767", "296.333", "297.633", 0.434, 0.464668),
        ("JPqiY3AA8EM_part005", "spk16", "есть", "просто", 282, 284, "124.767", "125.667", "125.3", "126.267", 0.367, 0.407778),
        ("JPqiY3AA8EM_part006", "spk16", "есть", "просто", 34, 36, "9.5", "10.467", "10.433", "11.4", 0.034, 0.03516),
        ("JPqiY3AA8EM_part006", "spk16", "когда", "будет", 158, 160, "57.933", "58.867", "58.667", "59.667", 0.2, 0.214133),
        ("JPqiY3AA8EM_part006", "spk16", "когда", "будет", 166, 168, "61.767", "62.667", "62.367", "63.333", 0.3, 0.333333),
        ("JPqiY3AA8EM_part006", "spk16", "когда", "будет", 176, 178, "66.7", "67.8", "67.3", "68.467", 0.5, 0.454545),
        ("JPqiY3AA8EM_part006", "spk16", "будет", "просто", 178, 180, "67.3", "68.467", "68.133", "69.1", 0.334, 0.345398),
        ("JPqiY3AA8EM_part007", "spk16", "есть", "когда", 317, 318, "133.867", "134.767", "134.067", "135.267", 0.7, 0.777778),
        ("JPqiY3AA8EM_part007", "spk16", "когда", "есть", 365, 366, "155.0", "156.3", "155.6", "156.767", 0.7, 0.599829),
        ("JPqiY3AA8EM_part007", "spk16", "чтобы", "потом", 677, 680, "293.7", "294.7", "294.633", "295.7", 0.067, 0.067),
        ("JPqiY3AA8EM_part009", "spk16", "чтобы", "потом", 64, 67, "32.967", "33.9", "33.6", "34.767", 0.3, 0.321543),
        ("JPqiY3AA8EM_part009", "spk16", "есть", "чтобы", 202, 205, "94.667", "95.533", "95.1", "96.1", 0.433, 0.5),
        ("JPqiY3AA8EM_part009", "spk16", "значит", "просто", 274, 276, "125.8", "127.567", "127.133", "128.167", 0.434, 0.419729),
        ("JPqiY3AA8EM_part009", "spk16", "есть", "будет", 449, 451, "191.467", "192.333", "192.1", "193.1", 0.233, 0.269053),
        ("JPqiY3AA8EM_part010", "spk16", "есть", "просто", 44, 47, "17.767", "18.667", "18.2", "19.2", 0.467, 0.518889),
        ("JPqiY3AA8EM_part010", "spk16", "есть", "просто", 85, 88, "30.0", "30.8", "30.4", "31.467", 0.4, 0.5),
        ("JPqiY3AA8EM_part010", "spk16", "может", "чтобы", 144, 145, "56.8", "57.7", "57.0", "58.0", 0.7, 0.777778),
        ("ebsNei9OHxA_part001", "spk17", "когда", "человек", 396, 397, "234.633", "235.567", "234.867", "235.867", 0.7, 0.749465),
        ("ebsNei9OHxA_part002", "spk17", "когда", "человек", 185, 186, "127.7", "129.333", "128.633", "130.367", 0.7, 0.428659),
        ("ebsNei9OHxA_part003", "spk17", "когда", "есть", 212, 215, "159.867", "161.067", "161.033", "162.033", 0.034, 0.034),
        ("ebsNei9OHxA_part004", "spk17", "человек", "есть", 83, 85, "46.467", "47.8", "47.233", "48.033", 0.567, 0.70875),
        ("ebsNei9OHxA_part006", "spk17", "когда", "будет", 117, 119, "72.333", "73.3", "72.833", "73.733", 0.467, 0.518889),
        ("ebsNei9OHxA_part007", "spk17", "потом", "будет", 345, 347, "201.267", "202.3", "201.8", "202.7", 0.5, 0.555556),
        ("ebsNei9OHxA_part007", "spk17", "потом", "будет", 365, 367, "208.6", "209.633", "209.167", "210.133", 0.466, 0.482402),
        ("V6mud3MtwaY_part007", "spk18", "когда", "есть", 371, 374, "188.76", "189.7", "189.32", "190.34", 0.38, 0.404255),
        ("V6mud3MtwaY_part009", "spk18", "когда", "человек", 56, 57, "28.52", "29.46", "28.72", "29.78", 0.74, 0.787234),
        ("V6mud3MtwaY_part009", "spk18", "когда", "человек", 66, 67, "32.4", "33.3", "32.56", "33.66", 0.74, 0.822222),
        ("cCLie_31-Zo_part001", "spk19", "когда", "человек", 369, 370, "259.65", "260.617", "260.117", "261.2", 0.5, 0.517063),
        ("cCLie_31-Zo_part003", "spk19", "есть", "человек", 269, 272, "192.733", "193.583", "193.467", "194.483", 0.116, 0.136471),
        ("cCLie_31-Zo_part003", "spk19", "человек", "когда", 379, 380, "263.75", "264.917", "264.317", "265.283", 0.6, 0.621118),
        ("cCLie_31-Zo_part004", "spk19", "просто", "когда", 110, 111, "85.467", "86.567", "86.117", "87.15", 0.45, 0.435624),
        ("cCLie_31-Zo_part004", "spk19", "просто", "человек", 110, 112, "85.467", "86.567", "86.55", "87.7", 0.017, 0.015455),
        ("cCLie_31-Zo_part004", "spk19", "когда", "человек", 111, 112, "86.117", "87.15", "86.55", "87.7", 0.6, 0.580833),
        ("cCLie_31-Zo_part005", "spk19", "есть", "время", 452, 453, "238.183", "239.15", "238.55", "239.4", 0.6, 0.705882),
        ("cCLie_31-Zo_part007", "spk19", "чтобы", "время", 417, 419, "250.283", "251.533", "251.35", "252.6", 0.183, 0.1464),
        ("cCLie_31-Zo_part009", "spk19", "будет", "просто", 248, 249, "160.467", "161.25", "160.65", "161.967", 0.6, 0.766284),
        ("cCLie_31-Zo_part009", "spk19", "когда", "человек", 420, 421, "268.483", "269.417", "268.883", "269.967", 0.534, 0.571734),
    ],
    "moderate_overlap_v3": [
        ("JPqiY3AA8EM_part001", "spk16", "значит", "есть", 357, 358, "188.187", "188.913", "188.687", "189.18", 0.226, 0.458418),
        ("JPqiY3AA8EM_part001", "spk16", "значит", "есть", 362, 363, "190.353", "190.947", "190.72", "191.313", 0.227, 0.382799),
        ("JPqiY3AA8EM_part001", "spk16", "значит", "есть", 368, 369, "193.753", "194.413", "194.187", "194.68", 0.226, 0.458418),
        ("JPqiY3AA8EM_part003", "spk16", "есть", "когда", 278, 279, "135.887", "136.28", "136.053", "136.88", 0.227, 0.577608),
        ("JPqiY3AA8EM_part006", "spk16", "когда", "будет", 176, 178, "66.887", "67.513", "67.487", "68.18", 0.026, 0.041534),
        ("JPqiY3AA8EM_part007", "spk16", "есть", "когда", 317, 318, "134.053", "134.48", "134.253", "134.98", 0.227, 0.531616),
        ("JPqiY3AA8EM_part007", "spk16", "когда", "есть", 365, 366, "155.187", "156.013", "155.787", "156.48", 0.226, 0.326118),
        ("JPqiY3AA8EM_part010", "spk16", "может", "чтобы", 144, 145, "56.987", "57.413", "57.187", "57.713", 0.226, 0.530516),
        ("ebsNei9OHxA_part001", "spk17", "когда", "человек", 396, 397, "234.82", "235.28", "235.053", "235.58", 0.227, 0.493478),
        ("ebsNei9OHxA_part002", "spk17", "когда", "человек", 185, 186, "127.887", "129.047", "128.82", "130.08", 0.227, 0.19569),
        ("ebsNei9OHxA_part004", "spk17", "человек", "есть", 83, 85, "46.653", "47.513", "47.42", "47.747", 0.093, 0.284404),
        ("ebsNei9OHxA_part007", "spk17", "потом", "будет", 345, 347, "201.453", "202.013", "201.987", "202.413", 0.026, 0.061033),
        ("V6mud3MtwaY_part009", "spk18", "когда", "человек", 56, 57, "28.72", "29.16", "28.92", "29.48", 0.24, 0.545455),
        ("V6mud3MtwaY_part009", "spk18", "когда", "человек", 66, 67, "32.6", "33.0", "32.76", "33.36", 0.24, 0.6),
        ("cCLie_31-Zo_part001", "spk19", "когда", "человек", 369, 370, "259.803", "260.363", "260.27", "260.947", 0.093, 0.166071),
        ("cCLie_31-Zo_part003", "spk19", "человек", "когда", 379, 380, "263.903", "264.663", "264.47", "265.03", 0.193, 0.344643),
        ("cCLie_31-Zo_part004", "spk19", "просто", "когда", 110, 111, "85.62", "86.313", "86.27", "86.897", 0.043, 0.068581),
        ("cCLie_31-Zo_part004", "spk19", "когда", "человек", 111, 112, "86.27", "86.897", "86.703", "87.447", 0.194, 0.30941),
        ("cCLie_31-Zo_part005", "spk19", "есть", "время", 452, 453, "238.337", "238.897", "238.703", "239.147", 0.194, 0.436937),
        ("cCLie_31-Zo_part009", "spk19", "будет", "просто", 248, 249, "160.62", "160.997", "160.803", "161.713", 0.194, 0.514589),
        ("cCLie_31-Zo_part009", "spk19", "когда", "человек", 420, 421, "268.637", "269.163", "269.037", "269.713", 0.126, 0.239544),
    ],
    "bounded_overlap_v3": [
        ("JPqiY3AA8EM_part001", "spk16", "значит", "есть", 266, 267, "190.353", "190.947", "190.72", "191.313", 0.227, 0.382799),
        ("JPqiY3AA8EM_part006", "spk16", "когда", "будет", 93, 94, "66.887", "67.513", "67.487", "68.18", 0.026, 0.041534),
        ("JPqiY3AA8EM_part007", "spk16", "когда", "есть", 225, 226, "155.187", "156.013", "155.787", "156.48", 0.226, 0.326118),
        ("ebsNei9OHxA_part002", "spk17", "когда", "человек", 144, 145, "127.887", "129.047", "128.82", "130.08", 0.227, 0.19569),
        ("cCLie_31-Zo_part001", "spk19", "когда", "человек", 308, 309, "259.803", "260.363", "260.27", "260.947", 0.093, 0.166071),
        ("cCLie_31-Zo_part003", "spk19", "человек", "когда", 333, 334, "263.903", "264.663", "264.47", "265.03", 0.193, 0.344643),
        ("cCLie_31-Zo_part004", "spk19", "просто", "когда", 97, 98, "85.62", "86.313", "86.27", "86.897", 0.043, 0.068581),
        ("cCLie_31-Zo_part004", "spk19", "когда", "человек", 98, 99, "86.27", "86.897", "86.703", "87.447", 0.194, 0.30941),
        ("cCLie_31-Zo_part005", "spk19", "есть", "время", 376, 377, "238.337", "238.897", "238.703", "239.147", 0.194, 0.436937),
        ("cCLie_31-Zo_part009", "spk19", "будет", "просто", 219, 220, "160.62", "160.997", "160.803", "161.713", 0.194, 0.514589),
        ("cCLie_31-Zo_part009", "spk19", "когда", "человек", 370, 371, "268.637", "269.163", "269.037", "269.713", 0.126, 0.239544),
    ],
    "padded_overlap_final_test": [
        ("fbYMX-LONNk_part001", "spk13", "значит", "будет", 137, 139, "91.433", "92.833", "92.533", "93.433", 0.3, 0.333333),
        ("fbYMX-LONNk_part001", "spk13", "просто", "чтобы", 402, 406, "207.033", "208.067", "208.0", "208.933", 0.067, 0.071811),
        ("fbYMX-LONNk_part002", "spk13", "просто", "будет", 6, 9, "2.433", "3.4", "3.367", "4.333", 0.033, 0.034161),
        ("fbYMX-LONNk_part002", "spk13", "потом", "может", 296, 299, "119.833", "120.833", "120.733", "121.633", 0.1, 0.111111),
        ("fbYMX-LONNk_part003", "spk13", "есть", "чтобы", 206, 209, "116.3", "117.1", "117.033", "118.2", 0.067, 0.08375),
        ("fbYMX-LONNk_part004", "spk13", "потом", "когда", 373, 374, "162.833", "163.833", "163.133", "164.1", 0.7, 0.723888),
        ("fbYMX-LONNk_part004", "spk13", "человек", "может", 427, 428, "191.7", "192.933", "192.867", "194.367", 0.066, 0.053528),
        ("fbYMX-LONNk_part005", "spk13", "время", "когда", 327, 328, "159.467", "160.367", "159.667", "160.633", 0.7, 0.777778),
        ("fbYMX-LONNk_part006", "spk13", "чтобы", "человек", 143, 144, "58.033", "59.0", "58.3", "59.333", 0.7, 0.723888),
        ("fbYMX-LONNk_part006", "spk13", "будет", "есть", 176, 178, "68.767", "69.7", "69.567", "70.367", 0.133, 0.16625),
        ("fbYMX-LONNk_part007", "spk13", "есть", "время", 320, 321, "149.233", "150.1", "149.4", "150.533", 0.7, 0.807382),
        ("fbYMX-LONNk_part007", "spk13", "человек", "может", 491, 493, "242.567", "243.6", "243.1", "244.0", 0.5, 0.555556),
        ("fbYMX-LONNk_part008", "spk13", "будет", "есть", 94, 97, "47.167", "48.2", "48.0", "48.8", 0.2, 0.25),
        ("fbYMX-LONNk_part008", "spk13", "есть", "будет", 97, 99, "48.0", "48.8", "48.533", "49.5", 0.267, 0.33375),
        ("fbYMX-LONNk_part008", "spk13", "человек", "будет", 155, 156, "75.767", "76.9", "76.2", "77.167", 0.7, 0.723888),
        ("fbYMX-LONNk_part008", "spk13", "есть", "будет", 326, 328, "148.9", "149.7", "149.2", "150.1", 0.5, 0.625),
        ("6wFa9kI3zrY_part001", "spk14", "когда", "человек", 321, 322, "185.1", "186.367", "186.1", "187.267", 0.267, 0.228792),
        ("6wFa9kI3zrY_part004", "spk14", "время", "будет", 151, 154, "75.5", "76.567", "76.433", "77.5", 0.134, 0.125586),
        ("6wFa9kI3zrY_part004", "spk14", "просто", "чтобы", 176, 177, "88.333", "89.433", "88.733", "89.733", 0.7, 0.7),
        ("6wFa9kI3zrY_part006", "spk14", "время", "будет", 495, 496, "293.999", "294.966", "294.266", "295.266", 0.7, 0.723888),
        ("6wFa9kI3zrY_part006", "spk14", "время", "может", 495, 497, "293.999", "294.966", "294.566", "295.499", 0.4, 0.428725),
        ("6wFa9kI3zrY_part006", "spk14", "будет", "может", 496, 497, "294.266", "295.266", "294.566", "295.499", 0.7, 0.750268),
        ("6wFa9kI3zrY_part008", "spk14", "когда", "просто", 329, 331, "195.467", "196.7", "196.334", "197.534", 0.366, 0.305),
        ("6wFa9kI3zrY_part010", "spk14", "время", "чтобы", 183, 184, "107.166", "108.2", "107.5", "108.566", 0.7, 0.676983),
        ("fp_mhQsTTcE_part008", "spk15", "есть", "когда", 301, 302, "151.267", "152.2", "151.767", "153.0", 0.433, 0.464094),
        ("fp_mhQsTTcE_part010", "spk15", "значит", "просто", 72, 74, "37.3", "38.467", "37.933", "39.0", 0.534, 0.500469),
    ],
}
REVIEW = {
    "padded_overlap_v3": [1, 2, 3, 4, 15, 16, 24, 25, 26, 28, 30, 29, 31, 27, 33, 34, 32, 37, 40, 41, 43, 44, 35, 38, 13, 22, 5, 8, 20, 19],
    "moderate_overlap_v3": [1, 3, 5, 0, 2, 6, 7, 8, 9, 10, 11, 12, 13, 17, 18, 19, 15, 20, 14, 16, 4],
    "bounded_overlap_v3": [0, 2, 1, 3, 7, 8, 9, 5, 10, 4, 6],
    "padded_overlap_final_test": [5, 7, 8, 10, 14, 11, 15, 0, 13, 12, 18, 19, 21, 23, 20, 22, 16, 17, 25, 24, 9, 3, 1, 4, 6, 2],
}
SAMPLER = [  # strategy, seed, validation_macro_f1
    ("speaker_word_inverse", 42, 0.525659),
    ("speaker_word_inverse", 123, 0.48493),
    ("speaker_word_inverse", 2026, 0.516642),
    ("speaker_word_sqrt", 42, 0.520295),
    ("speaker_word_sqrt", 123, 0.463794),
    ("speaker_word_sqrt", 2026, 0.57627),
    ("word_inverse", 42, 0.560317),
    ("word_inverse", 123, 0.461375),
    ("word_inverse", 2026, 0.624437),
    ("uniform_shuffle", 42, 0.545393),
    ("uniform_shuffle", 123, 0.560324),
    ("uniform_shuffle", 2026, 0.547428),
]
HFLIP = [  # fold_speaker, condition, seed, train_examples, validation_examples, validation_macro_f1
    ("spk03", "original", 42, 1779, 122, 0.454992),
    ("spk03", "original+hflip", 42, 3558, 122, 0.446676),
    ("spk03", "original", 123, 1779, 122, 0.485439),
    ("spk03", "original+hflip", 123, 3558, 122, 0.413158),
    ("spk03", "original", 2026, 1779, 122, 0.357669),
    ("spk03", "original+hflip", 2026, 3558, 122, 0.446924),
    ("spk17", "original", 42, 1741, 160, 0.427821),
    ("spk17", "original+hflip", 42, 3482, 160, 0.428598),
    ("spk17", "original", 123, 1741, 160, 0.424293),
    ("spk17", "original+hflip", 123, 3482, 160, 0.526133),
    ("spk17", "original", 2026, 1741, 160, 0.464766),
    ("spk17", "original+hflip", 2026, 3482, 160, 0.494058),
    ("spk19", "original", 42, 1740, 161, 0.280764),
    ("spk19", "original+hflip", 42, 3480, 161, 0.23314),
    ("spk19", "original", 123, 1740, 161, 0.216236),
    ("spk19", "original+hflip", 123, 3480, 161, 0.247994),
    ("spk19", "original", 2026, 1740, 161, 0.242342),
    ("spk19", "original+hflip", 2026, 3480, 161, 0.273483),
]
MSTCN = [  # fold_speaker, seed, bigru_hflip_macro_f1, validation_macro_f1
    ("spk03", 42, 0.446676, 0.698465),
    ("spk03", 123, 0.413158, 0.657397),
    ("spk03", 2026, 0.446924, 0.699259),
    ("spk17", 42, 0.428598, 0.547482),
    ("spk17", 123, 0.526133, 0.525563),
    ("spk17", 2026, 0.494058, 0.551206),
    ("spk19", 42, 0.23314, 0.537798),
    ("spk19", 123, 0.247994, 0.504027),
    ("spk19", 2026, 0.273483, 0.527397),
]
SAMPLER_SUMMARY = [  # strategy, mean, std, delta
    ("speaker_word_inverse", 0.509077, 0.021393, 0.0),
    ("speaker_word_sqrt", 0.52012, 0.056238, 0.011043),
    ("word_inverse", 0.54871, 0.082148, 0.039633),
    ("uniform_shuffle", 0.551049, 0.008097, 0.041971),
]
