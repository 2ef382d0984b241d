"""Word lists, patterns, classes and constants that results depend on."""

from __future__ import annotations

# They must equal the specification's for right results.

#: Terms of animal studies.
ANIMAL_PATTERNS = [
    r"\bmouse\b",
    r"\bmice\b",
    r"\bmurine\b",
    r"\bmus musculus\b",
    r"\brat\b",
    r"\brats\b",
    r"\brattus\b",
    r"\brattus norvegicus\b",
    r"\bwistar\b",
    r"\bwistar rat\b",
    r"\bsprague[- ]dawley\b",
    r"\bsprague dawley\b",
    r"\blong[- ]evans\b",
    r"\bfischer 344\b",
    r"\bcd[- ]1\b",
    r"\bguinea pig\b",
    r"\bhamster\b",
    r"\bgerbil\b",
    r"\bvole\b",
    r"\brabbit\b",
    r"\brabbits\b",
    r"\boryctolagus\b",
    r"\bdog\b",
    r"\bdogs\b",
    r"\bcanine\b",
    r"\bcanines\b",
    r"\bbeagle\b",
    r"\bcat\b",
    r"\bcats\b",
    r"\bfeline\b",
    r"\bpig\b",
    r"\bpigs\b",
    r"\bporcine\b",
    r"\bswine\b",
    r"\bmini[- ]pig\b",
    r"\bgottingen\b",
    r"\bmonkey\b",
    r"\bmonkeys\b",
    r"\bprimate\b",
    r"\bprimate model\b",
    r"\bmacaque\b",
    r"\brhesus\b",
    r"\bchimpanzee\b",
    r"\bbaboon\b",
    r"\bnonhuman primate\b",
    r"\bnhp\b",
    r"\bsheep\b",
    r"\bovine\b",
    r"\bcow\b",
    r"\bcalf\b",
    r"\bgoat\b",
    r"\bovine model\b",
    r"\bhorse\b",
    r"\bequine\b",
    r"\bchicken\b",
    r"\bhen\b",
    r"\bavian\b",
    r"\bbird\b",
    r"\bpoultry\b",
    r"\bzebrafish\b",
    r"\bfish\b",
    r"\bxenopus\b",
    r"\bfrog\b",
    r"\bdrosophila\b",
    r"\bfruit fly\b",
    r"\binsect\b",
    r"\bmosquito\b",
    r"\banimal model\b",
    r"\bexperimental animal\b",
    r"\bpreclinical\b",
    r"\bin vivo mouse\b",
    r"\bin vivo rat\b",
    r"\bmurine model\b",
]

#: Signs of a caption with several panels.
PANEL_PATTERNS = [
    r"\([A-Z]\)",
    r"\([a-z]\)",
    r"\([A-Z]\)\s*[-:]",
    r"\([a-z]\)\s*[-:]",
    r"\bpanel\s+[A-Z]\b",
    r"\bpanel\s+[a-z]\b",
    r"\bfig(?:ure)?\.?\s*\d+[A-Z]\b",
    r"^[A-Z]\s*:",
    r"^[a-z]\s*:",
    r"^[A-Z]\.",
    r"^[a-z]\.",
    r"\bpanels\b",
    r"\bsubfigure\b",
    r"\bsubfigures\b",
]

#: Classes that are filtered out, the same in every profile.
MICROSCOPY = [
    r"\bmicroscopy\b",
    r"\bmicroscopic\b",
    r"\bhistology\b",
    r"\bhistologic\w*\b",
    r"\bimmunohistochemistry\b",
    r"\bihc\b",
    r"\bh\s*&\s*e\b",
    r"\bhematoxylin\b",
    r"\beosin\b",
    r"\btissue section\b",
    r"\bpathology slide\b",
    r"\bstaining\b",
    r"\bcells\/hpf\b",
    r"\bhigh[- ]power field\b",
    r"\bmicroscop\w*\b",
    r"\bconfocal\b",
    r"\bfluorescen\w*\b.*\bmicroscop\w*\b",
    r"\belectron\s+microscop\w*\b",
    r"\bsem\b",
    r"\btem\b",
    r"\bimmunofluorescen\w*\b",
    r"\bstained\s+section\b",
    r"\bcell\s+culture\b",
    r"\bhigh[- ]magnification\b",
]
PATHOLOGY = [
    r"\bpathological findings\b",
    r"\bpathology\b",
    r"\bpathologic\w*\b",
    r"\bbiopsy\b",
    r"\bbiopsy findings\b",
    r"\btissue specimen\b",
    r"\bcell infiltration\b",
    r"\beosinophil counts\b",
    r"\binflammatory cell infiltration\b",
    r"\bhistolog\w*\b",
    r"\bh&e\b",
    r"\bhematoxylin\b",
    r"\beosin\b",
    r"\bimmunohistochem\w*\b",
    r"\bparaffin[- ]embedded\b",
    r"\btissue\s+section\b",
    r"\bbiopsy\b",
    r"\bpatholog\w*\b",
    r"\bstroma\b",
]
SURGERY = [
    r"\bintraoperative\b",
    r"\boperative findings\b",
    r"\bsurgical findings\b",
    r"\bsurgery\b",
    r"\bsurgical\b",
    r"\bsurgical view\b",
    r"\boperation\b",
    r"\bresected specimen\b",
    r"\bgross specimen\b",
    r"\bmacroscopic\b",
    r"\bclinical photograph\b",
    r"\bphotograph\b",
    r"\bphoto\b",
    r"\bwound\b",
    r"\blesion photograph\b",
    r"\bskin\b",
    r"\bcutaneous\b",
    r"\bdermatolog\w*\b",
    r"\bclinical\s+photograph\b",
    r"\bexternal\s+appearance\b",
    r"\blesion\b.*\bskin\b",
    r"\bface\b",
    r"\boral\s+cavity\b",
    r"\bphotograph\b",
    r"\bpatient\s+photo\b",
]
ENDOSCOPY = [
    r"\bendoscopy\b",
    r"\bendoscopic\b",
    r"\bcolonoscopy\b",
    r"\bgastroscopy\b",
    r"\besophagogastroduodenoscopy\b",
    r"\blaparoscopy\b",
    r"\bbronchoscopy\b",
    r"\bduodenoscopy\b",
    r"\benteroscopy\b",
    r"\bcolono fiberscope\b",
    r"\bcf\b",
    r"\bendoscop\w*\b",
    r"\bcolonoscopy\b",
    r"\bgastroscop\w*\b",
    r"\blaparoscop\w*\b",
    r"\bbronchoscop\w*\b",
    r"\bcystoscop\w*\b",
    r"\barthroscop\w*\b",
    r"\bduodenoscop\w*\b",
    r"\besophagoscop\w*\b",
    r"\bflexible\s+scope\b",
]
CHART = [
    r"\bchart\b",
    r"\bgraph\b",
    r"\bplot\b",
    r"\bdiagram\b",
    r"\bschematic\b",
    r"\bworkflow\b",
    r"\bhistogram\b",
    r"\bbox plot\b",
    r"\broc curve\b",
    r"\bsurvival curve\b",
    r"\bkaplan[- ]meier\b",
    r"\bbar graph\b",
    r"\bline graph\b",
    r"\bscatter plot\b",
    r"\bclinical course\b",
    r"\btherapeutic management\b",
    r"\bbody weight changes\b",
    r"\btimeline\b",
]

#: Imaging classes of the override profile.
OVERRIDE_ANGIO = [
    r"\bangiograph\w*\b",
    r"\bangioplasty\b",
    r"\bcoronary angiography\b",
    r"\bcatheter angiography\b",
    r"\bdigital subtraction angiography\b",
    r"\bdsa\b",
    r"\bfluoroscopy\b",
    r"\bfluoroscopic\b",
    r"\bc[- ]arm\b",
    r"\bx[- ]ray guided\b",
    r"\binterventional radiology\b",
    r"\bcatheterization\b",
    r"\bvascular intervention\b",
    r"\bembolization\b",
    r"\bcoil embolization\b",
    r"\bstent placement\b",
    r"\bpercutaneous coronary intervention\b",
    r"\bpci\b",
    r"\bptca\b",
    r"\bguidewire\b",
    r"\bcontrast injection\b",
    r"\bangiographic image\b",
    r"\broadmap fluoroscopy\b",
    r"\bfluoroscopic guidance\b",
]
OVERRIDE_US = [
    r"\bultrasound\b",
    r"\bsonograph\w*\b",
    r"\bultrasonograph\w*\b",
    r"\bdoppler\b",
    r"\bcolor doppler\b",
    r"\bpower doppler\b",
    r"\bduplex\b",
    r"\bb[- ]mode\b",
    r"\bechocardiograph\w*\b",
    r"\btransvaginal\b",
    r"\btransrectal\b",
    r"\btransabdominal\b",
    r"\bendoscopic ultrasound\b",
    r"\beus\b",
    r"\bfetal ultrasound\b",
    r"\bobstetric ultrasound\b",
    r"\bcarotid ultrasound\b",
]
OVERRIDE_HYBRID = [
    r"\bpet\s*/\s*ct\b",
    r"\bpet\s*-\s*ct\b",
    r"\bpetct\b",
    r"\bfdg\s*pet\s*/\s*ct\b",
    r"\bfdg[- ]pet[- ]ct\b",
    r"\bfused\s+pet\s*/\s*ct\b",
    r"\bhybrid\s+pet\s*/\s*ct\b",
    r"\bcombined\s+pet\s*/\s*ct\b",
    r"\bpet[- ]based\s+ct\b",
    r"\bpositron emission tomography\b.*\bct\b",
    r"\bspect\s*/\s*ct\b",
    r"\bspect\s*-\s*ct\b",
    r"\bspectct\b",
    r"\bfused\s+spect\s*/\s*ct\b",
    r"\bhybrid\s+spect\s*/\s*ct\b",
    r"\bsingle[- ]photon emission computed tomography\b.*\bct\b",
    r"\bmultimodal\b.*\bpet\b.*\bct\b",
    r"\bco[- ]registered\b.*\bpet\b.*\bct\b",
    r"\bfusion imaging\b.*\bpet\b.*\bct\b",
]
OVERRIDE_HIRN = [
    r"\bbrain\s+mri\b",
    r"\bbrain\s+mr\b",
    r"\bcranial\s+mri\b",
    r"\bcranial\s+mr\b",
    r"\bhead\s+mri\b",
    r"\bhead\s+mr\b",
    r"\bcerebral\s+mri\b",
    r"\bcerebral\s+mr\b",
    r"\bintracranial\b.*\bmri\b",
    r"\bhippocamp\w*\b",
    r"\bventricl\w*\b.*\bbrain\b",
    r"\bcorpus callosum\b",
    r"\bbasal ganglia\b",
    r"\bthalam\w*\b",
    r"\bbrainstem\b",
    r"\bcerebell\w*\b",
    r"\bglioblastoma\b",
    r"\bglioma\b",
    r"\bmeningioma\b",
    r"\bastrocytoma\b",
    r"\bmultiple sclerosis\b",
    r"\bms lesions\b",
    r"\bstroke\b.*\bmri\b",
    r"\bischemic stroke\b",
    r"\bepilep\w*\b",
    r"\bneurodegenerative\b",
    r"\bbrain\b.*\bflair\b",
    r"\bflair\b.*\bbrain\b",
    r"\bbrain\b.*\bt1\b",
    r"\bbrain\b.*\bt2\b",
    r"\bcerebral\b.*\bt1\b",
    r"\bcerebral\b.*\bt2\b",
    r"\bbrain\b.*\bdwi\b",
    r"\bbrain\b.*\badc\b",
    r"\bdiffusion[- ]weighted\b.*\bbrain\b",
    r"\bmra\b",
    r"\bmr angiography\b",
    r"\binternal carotid artery\b",
    r"\bmiddle cerebral artery\b",
    r"\bvertebral artery\b",
]
OVERRIDE_BODY = [
    r"\babdominal\s+mri\b",
    r"\bpelvic\s+mri\b",
    r"\bcardiac\s+mri\b",
    r"\bheart\s+mri\b",
    r"\bbreast\s+mri\b",
    r"\bspine\s+mri\b",
    r"\blumbar\s+mri\b",
    r"\bcervical\s+mri\b",
    r"\bthoracic\s+mri\b",
    r"\bmusculoskeletal\s+mri\b",
    r"\bwhole[- ]body\s+mri\b",
    r"\bliver\s+mri\b",
    r"\brenal\s+mri\b",
    r"\bkidney\s+mri\b",
    r"\bpancrea\w*\b.*\bmri\b",
    r"\bprostat\w*\b.*\bmri\b",
    r"\brectal\s+mri\b",
    r"\bpelvi\w*\b.*\bmri\b",
    r"\bknee\s+mri\b",
    r"\bshoulder\s+mri\b",
    r"\bhip\s+mri\b",
    r"\bankle\s+mri\b",
    r"\bjoint\s+mri\b",
    r"\bspine\b.*\bt1\b",
    r"\bspine\b.*\bt2\b",
    r"\bprostate\b.*\bt2\b",
    r"\bliver\b.*\bdwi\b",
    r"\bpelvis\b.*\badc\b",
    r"\bcardiac\b.*\bdelayed enhancement\b",
]
OVERRIDE_CT = [
    r"\bcomputed tomography\b",
    r"\bct scan\b",
    r"\baxial ct\b",
    r"\bcoronal ct\b",
    r"\bsagittal ct\b",
    r"\bcontrast[- ]enhanced ct\b",
    r"\bnon[- ]contrast ct\b",
    r"\bhelical ct\b",
    r"\bmultidetector ct\b",
    r"\bmdct\b",
    r"\bhrct\b",
    r"\bcect\b",
    r"\bhounsfield\b",
    r"\bcomputed tomography angiography\b",
    r"\bcta\b",
    r"\bthoracic ct\b",
    r"\bchest ct\b",
    r"\babdominal ct\b",
    r"\bpelvic ct\b",
    r"\bwhole[- ]body ct\b",
]
XRAY = [
    r"\bx[- ]?ray\b",
    r"\bxray\b",
    r"\bradiograph\b",
    r"\bradiographic\b",
    r"\bprojection radiography\b",
    r"\bfilm\b",
    r"\bportable x[- ]ray\b",
    r"\broentgen\b",
    r"\br\s*[öo]ntgen\b",
    r"\bdorsoplantar projection\b",
]

#: Imaging classes of the fusion and agreement profiles; the brain and body lists are dealt like cards.
FUSION_ANGIO = [
    r"\bangioplast\w*\b",
    r"\bangiography\w*\b",
    r"\bballoon angioplasty\b",
    r"\bpercutaneous transluminal angioplasty\b",
    r"\bpta\b",
    r"\bptca\b",
    r"\bcoronary angioplasty\b",
    r"\bstent placement\b",
    r"\bpercutaneous coronary intervention\b",
    r"\bpci\b",
    r"\bfluoroscopy\b",
    r"\bfluoroscopic\b",
    r"\bc[- ]arm\b",
    r"\bx[- ]ray guided\b",
    r"\bfluoroscopic guidance\b",
    r"\breal[- ]time x[- ]ray\b",
    r"\bangiograph\w*\b",
    r"\bdigital subtraction angiography\b",
    r"\bdsa\b",
    r"\bcatheter angiography\b",
]
FUSION_US = [
    r"\bultrasound\b",
    r"\bsonograph\w*\b",
    r"\bultrasonograph\w*\b",
    r"\bechograph\w*\b",
    r"\bechocardiograph\w*\b",
    r"\bultrasonic\b",
    r"\bdoppler\b",
    r"\bduplex sonograph\w*\b",
    r"\bendoscopic ultrasound\b",
    r"\beus\b",
    r"\bb[- ]mode ultrasound\b",
    r"\bcolor doppler\b",
    r"\bpower doppler\b",
    r"\btransvaginal\b",
    r"\btransrectal\b",
    r"\btransabdominal\b",
]
FUSION_HYBRID = [
    r"\bpet\s*/\s*ct\b",
    r"\bpet\s*-\s*ct\b",
    r"\bpetct\b",
    r"\bfused\s+pet\s*[-/]?\s*ct\b",
    r"\bhybrid\s+pet\s*[-/]?\s*ct\b",
    r"\bcombined\s+pet\s*[-/]?\s*ct\b",
    r"\bco[- ]registered\s+pet\s+(and\s+)?ct\b",
    r"\bspect\s*/\s*ct\b",
    r"\bspect\s*-\s*ct\b",
    r"\bspectct\b",
    r"\bfused\s+spect\s*[-/]?\s*ct\b",
    r"\bhybrid\s+spect\s*[-/]?\s*ct\b",
    r"\bcombined\s+spect\s*[-/]?\s*ct\b",
    r"\bco[- ]registered\s+spect\s+(and\s+)?ct\b",
    r"\bsingle[- ]photon emission computed tomography\s+(and|with)\s+ct\b",
    r"\bpositron emission tomography\s+(and|with)\s+computed tomography\b",
]
FUSION_CT = [
    r"\bct\b",
    r"\bct scan\b",
    r"\bcomputed tomography\b",
    r"\bcomputed tomograph\w*\b",
    r"\baxial ct\b",
    r"\bcoronal ct\b",
    r"\bsagittal ct\b",
    r"\bcontrast[- ]enhanced ct\b",
    r"\bnon[- ]contrast ct\b",
    r"\bhelical ct\b",
    r"\bmultidetector ct\b",
    r"\bmdct\b",
    r"\bhrct\b",
    r"\bcect\b",
    r"\bhounsfield\b",
]
FUSION_HIRN_PARTS = [
    [
        r"\bbrain\b.*\bt1\b",
        r"\bhead\b.*\bt1\b",
        r"\bcerebr\w*\b.*\bt1\b",
        r"\bcranial\b.*\bt1\b",
        r"\bt1[- ]weighted\b.*\bbrain\b",
        r"\bbrain\s+mri\b.*\bt1\b",
        r"\bbrain\s+magnetic\s+resonance\b",
        r"\bmra\b",
        r"\binternal\s+carotid\s+artery\b",
        r"\bica\b",
    ],
    [
        r"\bbrain\b.*\bt2\b",
        r"\bhead\b.*\bt2\b",
        r"\bcerebr\w*\b.*\bt2\b",
        r"\bcranial\b.*\bt2\b",
        r"\bt2[- ]weighted\b.*\bbrain\b",
        r"\bbrain\s+mri\b.*\bt2\b",
        r"\bbrain\s+magnetic\s+resonance\b",
        r"\bmra\b",
        r"\binternal\s+carotid\s+artery\b",
        r"\bica\b",
    ],
    [
        r"\bbrain\b.*\bflair\b",
        r"\bcranial\b.*\bflair\b",
        r"\bcerebr\w*\b.*\bflair\b",
        r"\bhead\b.*\bflair\b",
        r"\bflair\b.*\bbrain\b",
        r"\bfluid[- ]attenuated inversion recovery\b",
    ],
    [
        r"\bbrain\b.*\bt1\s*\+\s*c\b",
        r"\bbrain\b.*\bt1\s*post[- ]contrast\b",
        r"\bpost[- ]contrast\b.*\bbrain\b.*\bmri\b",
        r"\bgadolinium[- ]enhanced\b.*\bbrain\b.*\bmri\b",
        r"\bcontrast[- ]enhanced\b.*\bbrain\b.*\bmri\b",
        r"\bt1\s*\+\s*c\b.*\bbrain\b",
        r"\bt1\s+with\s+contrast\b.*\bbrain\b",
    ],
]
FUSION_BODY_PARTS = [
    [
        r"\bprostat\w*\b.*\bt1\b",
        r"\bt1[- ]weighted\b.*\bprostat\w*\b",
        r"\bprostate\s+mri\b.*\bt1\b",
        r"\bpelvic\s+mri\b.*\bprostat\w*\b.*\bt1\b",
    ],
    [
        r"\bprostat\w*\b.*\bt2\b",
        r"\bt2[- ]weighted\b.*\bprostat\w*\b",
        r"\bprostate\s+mri\b.*\bt2\b",
        r"\bpelvic\s+mri\b.*\bprostat\w*\b.*\bt2\b",
        r"\bzonal anatomy\b.*\bprostat\w*\b.*\bt2\b",
    ],
    [
        r"\bpelvic\s+mri\b",
        r"\bpelvic\s+mr\b",
        r"\bprostate\s+mri\b",
        r"\bprostate\s+mr\b",
        r"\bmpmri\b",
        r"\bmultiparametric\s+mri\b.*\bprostat\w*\b",
        r"\babdominal\s+mri\b",
        r"\bbreast\s+mri\b",
        r"\bliver\s+mri\b",
        r"\bkidney\s+mri\b",
        r"\brenal\s+mri\b",
        r"\bspine\s+mri\b",
        r"\bknee\s+mri\b",
        r"\bcardiac\s+mri\b",
        r"\bheart\s+mri\b",
        r"\bwhole[- ]body\s+mri\b",
        r"\bmri\b.*\bprostat\w*\b",
        r"\bmr\b.*\bprostat\w*\b",
        r"\bmri\b.*\bpelvi\w*\b",
        r"\bmr\b.*\bpelvi\w*\b",
        r"\bdiffusion[- ]weighted\b.*\bprostat\w*\b",
        r"\bdwi\b.*\bprostat\w*\b",
        r"\badc\b.*\bprostat\w*\b",
        r"\bdynamic contrast[- ]enhanced\b.*\bprostat\w*\b",
        r"\bdce\b.*\bprostat\w*\b",
        r"\babdominal\s+mr\b",
        r"\bbreast\s+mr\b",
        r"\bliver\s+mr\b",
        r"\bkidney\s+mr\b",
        r"\brenal\s+mr\b",
        r"\bspine\s+mr\b",
        r"\bknee\s+mr\b",
        r"\bcardiac\s+mr\b",
        r"\bheart\s+mr\b",
    ],
]

#: Class names.
HYBRID = "ct_kombimodalitaet_spect+ct_pet+ct"
ANGIO = "xray_fluoroskopie_angiographie"
CLASSES_FUSION = ["xray", ANGIO, "us", "mrt_hirn", "mrt_body", "ct", HYBRID]
CLASSES_OVERRIDE = ["ct", HYBRID, "us", "mrt_body", "mrt_hirn", "xray", ANGIO]
FILTER_CLASSES = ["microscopy", "pathology", "surgery_real", "endoscopy", "chart_or_diagram"]
#: Rulebook order, which settles what score and priority leave open.
RULE_ORDER = [ANGIO, "us", HYBRID, "mrt_hirn", "mrt_body", "ct", "xray", *FILTER_CLASSES]
PRIORITY_OVERRIDE = {HYBRID: 200, ANGIO: 180, "mrt_hirn": 160, "mrt_body": 150, "ct": 120, "xray": 100, "us": 90, "microscopy": 50, "pathology": 45, "surgery_real": 40, "endoscopy": 35, "chart_or_diagram": 30}
PRIORITY_FUSION = {"ct": 100, "us": 90, "mrt_hirn": 85, "mrt_body": 80, ANGIO: 80, HYBRID: 70, "xray": 65, "microscopy": 54, "pathology": 50, "surgery_real": 45, "endoscopy": 35, "chart_or_diagram": 34}
BONUS_FUSION = {"ct": 8, ANGIO: 5, "us": 8}
CNN1_MAPPING = {
    "xray": "xray", ANGIO: ANGIO, "us": "us", "mrt_hirn_flair": "mrt_hirn", "mrt_hirn_t1": "mrt_hirn", "mrt_hirn_t2": "mrt_hirn", "mrt_hirn_t1_c": "mrt_hirn",
    "mrt_prostata_t1": "mrt_body", "mrt_prostata_t2": "mrt_body", "ct": "ct", HYBRID: HYBRID,
}
CNN2_MAPPING = {c: c for c in ["xray", ANGIO, "mrt_hirn", "mrt_body"]}
TRASH_CLASSES = ["histologie", "haut", "chart", "endoskopie", "mikroskopie", "chirurgie"]
CNN1_COUNTS = {"xray": 54419, ANGIO: 3000, "us": 23804, "mrt_hirn": 4528, "mrt_body": 1666, "ct": 98158, HYBRID: 418723}
CNN2_COUNTS = {"xray": 60852, ANGIO: 6433, "mrt_hirn": 337909, "mrt_body": 32006}
FUSION_WEIGHT, TRASH_WEIGHT, CNN_ALPHA = 0.333, 0.3, 0.5
#: Phrases before a panel mark that make it a reference, and words that mark an enumeration as medical.
REFERENCE_PHRASES = ["shown in", "arrow in", "arrows in", "seen in", "shown on", "corresponding to", "compared with", "figure", "fig.", "magnification of", "higher magnification"]
ENUM_KEYWORDS = ["t1", "t2", "flair", "dwi", "adc", "mri", "ct", "pet", "x-ray", "xray", "ultrasound", "sagittal", "coronal", "axial", "contrast", "fat-suppressed", "enhanced", "diffusion", "echo", "spin", "repetition time", "te", "tr"]
BROKEN_ENDINGS = ["and", "or", "with", "to", "of", "for", "in", "on", "the", "a"]
BAD_BEFORE = ["in ", "from ", "of ", "panel ", "figure ", "fig ", "shown in ", "seen in ", "image in ", "corresponding to ", "indicates "]
LONE_LETTERS = ["T", "B"]
OCR_PANELS = [*"ABCDEFGHIJKLMNOPQRST", *"123456789"]
LEGACY_COLUMNS = [
    "row_id", "Final Label:", "RULE:", "BERT:", "CNN1top3", "CNN2top3", "LaMa:", "caption", "BERT_score", "CNN1_scores", "CNN2_scores", "LaMa_conf", "Final Scores", "Begründung", "uncertain", "pmc_id",
]
#: Panel names that the agreement profile's early sampler and the record scorers of two profiles look for.
OCR_PANELS_EARLY = [*"ABCDEFGHIJKLMNOPQRST", *map(str, range(1, 15))]
OCR_PANELS_RECORD = [*"ABCDEF"]
#: What the zero-shot text model compares a caption with.
CLASS_TEXTS = {
    "xray": (
        "X-ray radiography, radiograph, plain radiograph, chest x-ray, abdominal x-ray, "
        "skeletal radiograph, projection radiography, conventional x-ray, AP view, PA view, "
        "lateral view, portable x-ray, panoramic radiograph, dorsoplantar projection, "
        "plain film, frontal radiograph, lateral radiograph."
    ),
    "xray_fluoroskopie_angiographie": (
        "Fluoroscopy, fluoroscopic x-ray imaging, real-time x-ray imaging, c-arm fluoroscopy, "
        "x-ray guided interventional procedure, fluoroscopic guidance, contrast fluoroscopy, "
        "angiography, angiographic image, digital subtraction angiography, DSA, catheter angiography, "
        "vascular intervention, angioplasty, balloon angioplasty, percutaneous transluminal angioplasty, "
        "PTA, PTCA, coronary angioplasty, stent placement, percutaneous coronary intervention, PCI."
    ),
    "us": (
        "Ultrasound imaging, sonography, ultrasonography, echography, echocardiography, "
        "B-mode ultrasound, doppler ultrasound, duplex sonography, endoscopic ultrasound, EUS, "
        "color doppler, power doppler, sonographic examination, ultrasonographic image."
    ),
    "mrt_hirn": (
        "Brain MRI, cranial MRI, cerebral MRI, neuro MRI, head MRI, magnetic resonance imaging of the brain, "
        "T1-weighted brain MRI, T2-weighted brain MRI, FLAIR brain MRI, fluid-attenuated inversion recovery, "
        "DWI brain MRI, ADC brain MRI, contrast-enhanced T1 brain MRI, gadolinium-enhanced brain MRI, "
        "post-contrast brain MRI, axial brain MRI, sagittal brain MRI, coronal brain MRI."
    ),
    "mrt_body": (
        "Body MRI, magnetic resonance imaging outside the brain, abdominal MRI, pelvic MRI, prostate MRI, "
        "breast MRI, liver MRI, renal MRI, kidney MRI, cardiac MRI, heart MRI, spine MRI, knee MRI, "
        "whole-body MRI, multiparametric prostate MRI, mpMRI, prostate T1-weighted MRI, prostate T2-weighted MRI, "
        "diffusion-weighted prostate MRI, ADC map of prostate MRI, dynamic contrast-enhanced prostate MRI, DCE MRI, "
        "pelvic MR imaging of the prostate gland."
    ),
    "ct": (
        "Computed tomography, CT scan, computed tomographic image, axial CT, coronal CT, sagittal CT, "
        "contrast-enhanced CT, non-contrast CT, helical CT, multidetector CT, MDCT, HRCT, "
        "brain CT, chest CT, abdominal CT, pelvic CT, Hounsfield units."
    ),
    "ct_kombimodalitaet_spect+ct_pet+ct": (
        "Hybrid CT imaging with PET or SPECT, PET/CT, PET-CT, fused PET-CT image, hybrid PET/CT imaging, "
        "co-registered PET and CT, combined positron emission tomography and computed tomography, "
        "SPECT/CT, SPECT-CT, fused SPECT-CT image, hybrid single-photon emission computed tomography and CT, "
        "nuclear medicine hybrid imaging, tracer uptake co-registered with CT anatomy."
    ),
    "microscopy": (
        "Microscopy, microscopic image, histology, histopathology, pathology slide, tissue section, "
        "H and E stain, hematoxylin and eosin staining, immunohistochemistry, IHC staining, "
        "cells per high-power field, microscopic tissue morphology."
    ),
    "pathology": (
        "Pathology, pathological findings, biopsy findings, tissue pathology, biopsy specimen, "
        "inflammatory cells, eosinophil counts, pathological examination, tissue specimen, "
        "cell infiltration, histopathological diagnosis."
    ),
    "surgery_real": (
        "Real clinical photograph, photo, a photo of, photograph, surgical photograph, intraoperative photograph, operative findings, "
        "surgical field, surgical view, surgical photo, photo of surgery, photo of surgical, gross, macroscopic specimen, resected specimen, gross specimen, "
        "wound photograph, lesion photograph, real-world medical image from operation or clinical examination."
    ),
    "endoscopy": (
        "Endoscopy, colonoscopy, gastroscopy, bronchoscopy, enteroscopy, duodenoscopy, laparoscopic view, "
        "endoscopic findings, mucosal findings, colono fiberscope, gastrointestinal endoscopy."
    ),
    "chart_or_diagram": (
        "Chart, graph, plot, line graph, bar chart, histogram, box plot, schematic, workflow figure, "
        "timeline, clinical course figure, therapeutic management chart, Kaplan-Meier curve, ROC curve."
    ),
    "unknown": (
        "Unknown or not identifiable modality, insufficient information, unclear caption."
    ),
}
