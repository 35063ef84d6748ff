"""The 103-row sales sample, as rows. Fixed values."""

CSV = """\
Date,Region,Product,Revenue,Quantity,Profit,Customer_ID
2026-01-01,West,Tablet,15261.141204714511,2,2210.41098967129,C-000
2026-01-02,South,Phone,14102.977948602398,5,2307.8091335048875,C-001
2026-01-03,North,Phone,15275.282329606507,1,2172.9350326465224,C-002
2026-01-04,West,Headphones,9037.29325619732,1,1378.4910316526418,C-003
2026-01-05,West,Phone,14340.984336487463,5,2117.2090211553,C-004
2026-01-06,South,Phone,85000.0,3,12668.472906347808,C-005
2026-01-07,North,Phone,19433.68213422455,4,2984.961558319681,C-006
2026-01-08,North,Headphones,13445.189345179058,3,2076.768065147959,C-007
2026-01-09,West,Phone,12574.519191320436,1,1838.0530653157148,C-008
2026-01-10,East,Tablet,13494.72886924639,1,1814.829929983452,C-009
2026-01-11,West,Headphones,,5,2619.926206503182,C-010
2026-01-12,West,Tablet,,6,2411.8584104425395,C-011
2026-01-13,West,Headphones,,3,2011.7892694243,C-012
2026-01-14,West,Phone,,9,2556.563873080175,C-013
2026-01-15,South,Tablet,,5,2487.039160149617,C-014
2026-01-16,North,Headphones,17905.93497159867,8,2727.277729464881,C-015
2026-01-17,South,Laptop,12893.840718367945,1,1990.8529445309537,C-016
2026-01-18,South,Phone,14017.013560206697,5,2117.370207168919,C-017
2026-01-19,South,Headphones,13823.675540603526,3,2190.7949093297534,C-018
2026-01-20,West,Laptop,10609.455155603644,1,1644.5582744365795,C-019
2026-01-21,,Headphones,15888.360831193728,4,2458.1646923754915,C-020
2026-01-22,,Laptop,15783.165816539668,5,2548.3705553829664,C-021
2026-01-23,,Phone,15015.340369927382,7,2274.999485611042,C-022
2026-01-24,,Tablet,14296.23859987456,1,2117.33956376441,C-023
2026-01-25,,Laptop,10753.887773848755,3,1657.7121008775052,C-024
2026-01-26,East,Headphones,95000.0,2,14363.624231711929,C-025
2026-01-27,East,Phone,13971.856450419691,9,2145.921143265562,C-026
2026-01-28,East,Laptop,12593.168192335144,6,1995.0390867324124,C-027
2026-01-29,South,Headphones,14516.142865001972,3,2110.5239470186275,C-028
2026-01-30,South,Headphones,16212.152570443615,8,2345.0144630260934,C-029
2026-01-31,North,Headphones,20658.55770363159,8,3044.2798940100297,C-030
2026-02-01,North,Laptop,15523.733438495516,2,2201.821785623094,C-031
2026-02-02,South,Laptop,15772.651172168293,6,2376.927633688586,C-032
2026-02-03,East,Laptop,14776.6622527015,7,2173.496799320233,C-033
2026-02-04,East,Tablet,9243.686354102876,2,1509.5740884798693,C-034
2026-02-05,North,Laptop,14920.45837365235,2,2108.946319828105,C-035
2026-02-06,South,Laptop,15180.69062982308,1,2432.595862137122,C-036
2026-02-07,North,Laptop,22389.72633745586,8,3260.338917094624,C-037
2026-02-08,North,Tablet,14422.917105656632,1,2039.6144807336595,C-038
2026-02-09,West,Laptop,15904.642027000837,9,2303.2311712850183,C-039
2026-02-10,West,Headphones,14895.86469088427,6,2429.507712206216,C-040
2026-02-11,West,Laptop,11493.965887141405,7,1720.0863693339102,C-041
2026-02-12,East,Headphones,18428.46844354506,7,2817.21381769714,C-042
2026-02-13,South,Headphones,17255.79909806032,3,2569.980690936246,C-043
2026-02-14,South,Headphones,17373.09584112914,2,2596.9565128513505,C-044
2026-02-15,South,Tablet,12271.837635615782,9,1790.187640018938,C-045
2026-02-16,South,Tablet,19208.382932808297,8,2886.331835806771,C-046
2026-02-17,West,Tablet,10794.446811623158,7,1668.6270109316451,C-047
2026-02-18,East,Laptop,16760.57128140081,9,2681.916243192411,C-048
2026-02-19,East,Headphones,21571.366877429937,4,3048.2581441285392,C-049
2026-02-20,West,Tablet,12028.391024607936,4,1965.3406846304408,C-050
2026-02-21,East,Tablet,13301.106811191685,1,2047.9620643814,C-051
2026-02-22,West,Laptop,15298.954095262923,8,2258.066836024136,C-052
2026-02-23,South,Tablet,13489.573037651402,3,1968.6636073517773,C-053
2026-02-24,West,Laptop,10348.009706801602,7,1656.5690205571154,C-054
2026-02-25,South,Phone,15205.688924418082,2,2303.7511924815662,C-055
2026-02-26,South,Tablet,11813.088858821686,2,1618.55681695336,C-056
2026-02-27,North,Phone,16420.777291905546,7,2499.4235541195626,C-057
2026-02-28,West,Laptop,12241.72729729859,6,1950.6962481422568,C-058
2026-03-01,North,Headphones,19649.80321505262,3,3033.2569481367395,C-059
2026-03-02,West,Tablet,12650.240122991288,9,1834.8502314948776,C-060
2026-03-03,West,Laptop,14033.815451382974,6,1970.8715873021104,C-061
2026-03-04,North,Headphones,17440.55165210901,6,2583.485433718203,C-062
2026-03-05,North,Headphones,11307.407050698132,1,2021.5095702134804,C-063
2026-03-06,West,Phone,15682.379803812388,4,2197.8570757121583,C-064
2026-03-07,East,Laptop,18921.428262847283,6,2753.9407297784,C-065
2026-03-08,South,Headphones,10177.550296316316,6,1565.8367334207069,C-066
2026-03-09,North,Tablet,15553.901575596912,5,2320.632711580168,C-067
2026-03-10,South,Tablet,15779.64838274527,1,2346.926767838683,C-068
2026-03-11,East,Phone,17345.46861533193,8,2804.29239209989,C-069
2026-03-12,East,Headphones,11289.147867365757,5,1608.0461859010657,C-070
2026-03-13,East,Laptop,11038.63016074717,5,1654.366469341566,C-071
2026-03-14,North,Tablet,16565.824696850694,7,2505.0644487078835,C-072
2026-03-15,East,Headphones,15890.95401969956,4,2303.169434447384,C-073
2026-03-16,North,Headphones,15751.47855103763,6,2218.6565087749627,C-074
2026-03-17,East,Phone,16039.344628490928,4,2432.833459698893,C-075
2026-03-18,South,Tablet,12959.925835264528,3,2125.3555328775697,C-076
2026-03-19,South,Tablet,15696.761091483011,7,2394.972453234204,C-077
2026-03-20,West,Laptop,15879.217419896044,8,2390.8898716825724,C-078
2026-03-21,South,Tablet,12856.945745920895,4,1936.8149054681824,C-079
2026-03-22,West,Laptop,20597.323533434268,2,3063.7567564333967,C-080
2026-03-23,South,Tablet,16421.498762735362,3,2581.5730464244043,C-081
2026-03-24,North,Phone,11426.089508392057,1,1663.3691988796218,C-082
2026-03-25,South,Tablet,16969.66082590149,8,2409.7705754433678,C-083
2026-03-26,West,Laptop,12075.954989318036,3,1653.227855836251,C-084
2026-03-27,West,Laptop,17361.253811227354,7,2612.0889731085085,C-085
2026-03-28,East,Phone,18475.78673702221,5,2877.437256871362,C-086
2026-03-29,North,Tablet,12537.953044944868,5,1904.441481903924,C-087
2026-03-30,South,Tablet,17890.128387732966,7,2651.7823796328807,C-088
2026-03-31,East,Phone,16238.342780809497,9,2481.595546777622,C-089
2026-04-01,South,Tablet,17466.18047998347,5,2638.5483063869838,C-090
2026-04-02,South,Tablet,20690.378947961843,1,3186.1758895597027,C-091
2026-04-03,East,Laptop,14263.835651991389,1,2272.2257365423857,C-092
2026-04-04,East,Tablet,12738.791506927531,2,1815.37971318183,C-093
2026-04-05,East,Tablet,12331.45671112343,6,1615.7588503041743,C-094
2026-04-06,East,Phone,12552.569145103686,9,1847.731691903508,C-095
2026-04-07,East,Phone,14768.694871757689,8,2113.370084039646,C-096
2026-04-08,South,Headphones,16023.455924449932,5,2486.714207324941,C-097
2026-04-09,East,Laptop,15830.072397990058,1,2302.077480163799,C-098
2026-04-10,North,Tablet,17481.54974710807,7,2434.6545982098164,C-099
2026-01-01,West,Tablet,15261.141204714511,2,2210.41098967129,C-000
2026-01-02,South,Phone,14102.977948602398,5,2307.8091335048875,C-001
2026-01-03,North,Phone,15275.282329606507,1,2172.9350326465224,C-002
"""
