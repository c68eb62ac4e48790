"""Word lists, code tables and patterns that results depend on, in their natural order."""

TARGET_SCHEMAS = {
    
    'healthcare': {'patient_id': ['patient_id', 'pt_id', 'pid', 'mrn', 'medical_record_number', 'uhid'], 'patient_name': ['name', 'patient_name', 'pt_name', 'full_name', 'patient_nm'], 'age': ['age', 'age_years', 'patient_age', 'yrs'], 'gender': ['gender', 'sex'], 'diagnosis': ['diagnosis', 'dx', 'condition', 'disease'], 'admission_date': ['admission_date', 'admit_date', 'visit_date', 'encounter_date'], 'discharge_date': ['discharge_date', 'release_date'], 'blood_pressure': ['blood_pressure', 'bp', 'systolic_bp', 'diastolic_bp'], 'heart_rate': ['heart_rate', 'hr', 'pulse']},
    'general': {'id': ['id', 'identifier', 'record_id'], 'name': ['name', 'full_name', 'title'], 'date': ['date', 'created_date', 'timestamp'], 'amount': ['amount', 'price', 'cost', 'value'], 'category': ['category', 'type', 'segment'], 'status': ['status', 'state']},
}

WORD_ABBREVIATIONS = {
    'bp': 'Blood Pressure', 'hr': 'Heart Rate', 'rr': 'Respiratory Rate', 'temp': 'Temperature', 'spo2': 'Oxygen Saturation', 'bmi': 'Body Mass Index',
    'bpm': 'Beats Per Minute', 'mmhg': 'Millimeters of Mercury', 'dx': 'Diagnosis', 'rx': 'Prescription', 'tx': 'Treatment', 'hx': 'History', 'sx': 'Symptoms',
    'fx': 'Fracture', 'sob': 'Shortness of Breath', 'cp': 'Chest Pain', 'ha': 'Headache', 'n/v': 'Nausea/Vomiting', 'abd': 'Abdominal', 'bilat': 'Bilateral',
    'nkda': 'No Known Drug Allergies', 'nka': 'No Known Allergies', 'prn': 'As Needed', 'bid': 'Twice Daily', 'tid': 'Three Times Daily', 'qid': 'Four Times Daily',
    'qd': 'Once Daily', 'qh': 'Every Hour', 'q2h': 'Every 2 Hours', 'q4h': 'Every 4 Hours', 'q6h': 'Every 6 Hours', 'q8h': 'Every 8 Hours', 'q12h': 'Every 12 Hours',
    'hs': 'At Bedtime', 'ac': 'Before Meals', 'pc': 'After Meals', 'stat': 'Immediately', 'po': 'By Mouth', 'iv': 'Intravenous', 'im': 'Intramuscular', 'sc': 'Subcutaneous',
    'sl': 'Sublingual', 'pr': 'Per Rectum', 'inh': 'Inhalation', 'top': 'Topical', 'dm': 'Diabetes Mellitus', 'dm2': 'Diabetes Mellitus Type 2',
    'dm1': 'Diabetes Mellitus Type 1', 'htn': 'Hypertension', 'cad': 'Coronary Artery Disease', 'chf': 'Congestive Heart Failure',
    'copd': 'Chronic Obstructive Pulmonary Disease', 'ckd': 'Chronic Kidney Disease', 'uti': 'Urinary Tract Infection', 'dvt': 'Deep Vein Thrombosis',
    'pe': 'Pulmonary Embolism', 'mi': 'Myocardial Infarction', 'cva': 'Cerebrovascular Accident', 'tia': 'Transient Ischemic Attack', 'afib': 'Atrial Fibrillation',
    'ards': 'Acute Respiratory Distress Syndrome', 'aki': 'Acute Kidney Injury', 'bph': 'Benign Prostatic Hyperplasia', 'gerd': 'Gastroesophageal Reflux Disease',
    'ibs': 'Irritable Bowel Syndrome', 'osa': 'Obstructive Sleep Apnea', 'ra': 'Rheumatoid Arthritis', 'sle': 'Systemic Lupus Erythematosus', 'tb': 'Tuberculosis',
    'hiv': 'Human Immunodeficiency Virus', 'aids': 'Acquired Immunodeficiency Syndrome', 'ms': 'Multiple Sclerosis', 'gad': 'Generalized Anxiety Disorder',
    'ptsd': 'Post-Traumatic Stress Disorder', 'adhd': 'Attention Deficit Hyperactivity Disorder', 'ocd': 'Obsessive Compulsive Disorder', 'cbc': 'Complete Blood Count',
    'bmp': 'Basic Metabolic Panel', 'cmp': 'Comprehensive Metabolic Panel', 'lfts': 'Liver Function Tests', 'abg': 'Arterial Blood Gas', 'ekg': 'Electrocardiogram',
    'ecg': 'Electrocardiogram', 'ct': 'Computed Tomography', 'mri': 'Magnetic Resonance Imaging', 'cxr': 'Chest X-Ray', 'us': 'Ultrasound', 'eeg': 'Electroencephalogram',
    'echo': 'Echocardiogram', 'emg': 'Electromyography', 'wbc': 'White Blood Cell', 'rbc': 'Red Blood Cell', 'hgb': 'Hemoglobin', 'hct': 'Hematocrit', 'plt': 'Platelets',
    'inr': 'International Normalized Ratio', 'ptt': 'Partial Thromboplastin Time', 'esr': 'Erythrocyte Sedimentation Rate', 'crp': 'C-Reactive Protein',
    'hba1c': 'Glycated Hemoglobin', 'a1c': 'Glycated Hemoglobin', 'tsh': 'Thyroid Stimulating Hormone', 'bun': 'Blood Urea Nitrogen', 'gfr': 'Glomerular Filtration Rate',
    'psa': 'Prostate-Specific Antigen', 'alt': 'Alanine Transaminase', 'ast': 'Aspartate Transaminase', 'alp': 'Alkaline Phosphatase', 'bnp': 'Brain Natriuretic Peptide',
    'ldl': 'Low-Density Lipoprotein', 'hdl': 'High-Density Lipoprotein', 'er': 'Emergency Room', 'ed': 'Emergency Department', 'icu': 'Intensive Care Unit',
    'nicu': 'Neonatal ICU', 'picu': 'Pediatric ICU', 'pacu': 'Post-Anesthesia Care Unit', 'rn': 'Registered Nurse',
}

DISEASE_CODES = {
    'diabetes': 'E11', 'diabetes mellitus': 'E11', 'diabetes mellitus type 2': 'E11', 'type 2 diabetes': 'E11', 'type ii diabetes': 'E11', 'dm2': 'E11',
    'diabetes mellitus type 1': 'E10', 'type 1 diabetes': 'E10', 'dm1': 'E10', 'gestational diabetes': 'O24', 'high blood sugar': 'E11', 'hyperglycemia': 'R73.9',
    'hypertension': 'I10', 'htn': 'I10', 'high blood pressure': 'I10', 'heart failure': 'I50', 'chf': 'I50.9', 'congestive heart failure': 'I50.9',
    'coronary artery disease': 'I25.10', 'cad': 'I25.10', 'myocardial infarction': 'I21', 'heart attack': 'I21', 'atrial fibrillation': 'I48', 'afib': 'I48',
    'angina': 'I20', 'stroke': 'I63', 'cva': 'I63', 'cerebrovascular accident': 'I63', 'dvt': 'I82', 'deep vein thrombosis': 'I82', 'pulmonary embolism': 'I26',
    'hyperlipidemia': 'E78.5', 'high cholesterol': 'E78.0', 'hypotension': 'I95', 'asthma': 'J45', 'copd': 'J44', 'chronic obstructive pulmonary disease': 'J44',
    'pneumonia': 'J18', 'bronchitis': 'J40', 'emphysema': 'J43', 'tuberculosis': 'A15', 'tb': 'A15', 'covid': 'U07.1', 'covid-19': 'U07.1', 'coronavirus': 'U07.1',
    'influenza': 'J11', 'flu': 'J11', 'upper respiratory infection': 'J06.9', 'pharyngitis': 'J02.9', 'sinusitis': 'J32', 'sleep apnea': 'G47.3', 'gerd': 'K21',
    'acid reflux': 'K21', 'gastritis': 'K29', 'peptic ulcer': 'K27', 'ibs': 'K58', 'irritable bowel syndrome': 'K58', "crohn's disease": 'K50', 'ulcerative colitis': 'K51',
    'cirrhosis': 'K74', 'hepatitis': 'K75', 'hepatitis b': 'B16', 'hepatitis c': 'B17.1', 'pancreatitis': 'K85', 'gallstones': 'K80', 'appendicitis': 'K35',
    'osteoarthritis': 'M19', 'rheumatoid arthritis': 'M06', 'osteoporosis': 'M81', 'gout': 'M10', 'back pain': 'M54', 'low back pain': 'M54.5', 'fibromyalgia': 'M79.7',
    'epilepsy': 'G40', 'seizure': 'R56', 'migraine': 'G43', "parkinson's disease": 'G20', "alzheimer's disease": 'G30', 'dementia': 'F03', 'multiple sclerosis': 'G35',
    'neuropathy': 'G62.9', 'chronic kidney disease': 'N18', 'ckd': 'N18', 'acute kidney injury': 'N17', 'urinary tract infection': 'N39.0', 'uti': 'N39.0',
    'kidney stones': 'N20', 'hypothyroidism': 'E03', 'hyperthyroidism': 'E05', 'obesity': 'E66', 'depression': 'F32', 'major depression': 'F33', 'anxiety': 'F41',
    'bipolar disorder': 'F31', 'schizophrenia': 'F20', 'ptsd': 'F43.1', 'insomnia': 'G47.0', 'adhd': 'F90', 'sepsis': 'A41', 'cellulitis': 'L03', 'meningitis': 'G03',
    'hiv': 'B20', 'malaria': 'B54', 'dengue': 'A90', 'typhoid': 'A01.0', 'eczema': 'L30.9', 'psoriasis': 'L40', 'acne': 'L70', 'breast cancer': 'C50', 'lung cancer': 'C34',
    'colon cancer': 'C18', 'prostate cancer': 'C61', 'leukemia': 'C95', 'lymphoma': 'C85', 'anemia': 'D64.9', 'iron deficiency anemia': 'D50', 'sickle cell disease': 'D57',
    'thalassemia': 'D56', 'fever': 'R50.9', 'cough': 'R05', 'fatigue': 'R53', 'chest pain': 'R07.9', 'headache': 'R51', 'nausea': 'R11', 'edema': 'R60',
    'dehydration': 'E86',
}

SPELLING_FIXES = {
    'diabeties': 'diabetes', 'diabtes': 'diabetes', 'diabetis': 'diabetes', 'hypertention': 'hypertension', 'hypertenshion': 'hypertension', 'pnuemonia': 'pneumonia',
    'pneumnia': 'pneumonia', 'pnemonia': 'pneumonia', 'astma': 'asthma', 'asthama': 'asthma', 'epilepsey': 'epilepsy', 'epilepcy': 'epilepsy', 'arrythmia': 'arrhythmia',
    'arythmia': 'arrhythmia', 'diarrhoea': 'diarrhea', 'diarhea': 'diarrhea', 'hemorrage': 'hemorrhage', 'haemorrhage': 'hemorrhage', 'aneurism': 'aneurysm',
    'cathater': 'catheter', 'excema': 'eczema', 'exzema': 'eczema', 'hemogloben': 'hemoglobin', 'haemoglobin': 'hemoglobin', 'influensa': 'influenza',
    'luekemia': 'leukemia', 'lukemia': 'leukemia', 'menigitis': 'meningitis', 'meningitus': 'meningitis', 'osteoporisis': 'osteoporosis', 'osteoporasis': 'osteoporosis',
    'psorisis': 'psoriasis', 'rhuematoid': 'rheumatoid', 'schizophrena': 'schizophrenia', 'skizofrenia': 'schizophrenia', 'tuberclosis': 'tuberculosis',
    'tuburculosis': 'tuberculosis', 'tonsilitis': 'tonsillitis', 'broncitis': 'bronchitis', 'colestrol': 'cholesterol', 'cholestrol': 'cholesterol',
    'cirrhossis': 'cirrhosis', 'alzhiemers': "alzheimer's", 'hypothyrodism': 'hypothyroidism', 'gastritus': 'gastritis', 'appendecitis': 'appendicitis',
    'pancreatitus': 'pancreatitis', 'anaemia': 'anemia', 'thalessemia': 'thalassemia', 'fibromalgia': 'fibromyalgia', 'nueropathy': 'neuropathy', 'sepssis': 'sepsis',
    'parkinsons': "parkinson's",
}

LOINC_NAMES = {
    '2345-7': 'Glucose', '2160-0': 'Creatinine', '3094-0': 'BUN', '2951-2': 'Sodium', '2823-3': 'Potassium', '2075-0': 'Chloride', '17861-6': 'Calcium', '1751-7': 'Albumin',
    '1742-6': 'ALT', '1920-8': 'AST', '6768-6': 'ALP', '2093-3': 'Total Cholesterol', '2571-8': 'Triglycerides', '2085-9': 'HDL', '2089-1': 'LDL', '4548-4': 'HbA1c',
    '718-7': 'Hemoglobin', '4544-3': 'Hematocrit', '6690-2': 'WBC', '789-8': 'RBC', '777-3': 'Platelets', '6301-6': 'INR', '30341-2': 'ESR', '1988-5': 'CRP',
    '3016-3': 'TSH', '33914-3': 'eGFR', '2947-0': 'PSA',
}

TEXT_ABBREVIATIONS = {
    'bp': 'Blood Pressure', 'hr': 'Heart Rate', 'rr': 'Respiratory Rate', 'temp': 'Temperature', 'spo2': 'Oxygen Saturation', 'bmi': 'Body Mass Index', 'dx': 'Diagnosis',
    'rx': 'Prescription', 'tx': 'Treatment', 'hx': 'History', 'sx': 'Symptoms', 'fx': 'Fracture', 'sob': 'Shortness of Breath', 'cp': 'Chest Pain', 'ha': 'Headache',
    'nkda': 'No Known Drug Allergies', 'nka': 'No Known Allergies', 'prn': 'As Needed', 'bid': 'Twice Daily', 'tid': 'Three Times Daily', 'qid': 'Four Times Daily',
    'qd': 'Once Daily', 'po': 'By Mouth', 'iv': 'Intravenous', 'im': 'Intramuscular', 'sc': 'Subcutaneous', 'sl': 'Sublingual', 'dm': 'Diabetes Mellitus',
    'dm2': 'Diabetes Mellitus Type 2', 'htn': 'Hypertension', 'cad': 'Coronary Artery Disease', 'chf': 'Congestive Heart Failure',
    'copd': 'Chronic Obstructive Pulmonary Disease', 'ckd': 'Chronic Kidney Disease', 'uti': 'Urinary Tract Infection', 'dvt': 'Deep Vein Thrombosis',
    'pe': 'Pulmonary Embolism', 'mi': 'Myocardial Infarction', 'cva': 'Cerebrovascular Accident', 'afib': 'Atrial Fibrillation',
    'nstemi': 'Non-ST Elevation Myocardial Infarction', 'stemi': 'ST Elevation Myocardial Infarction', 'bmp': 'Basic Metabolic Panel', 'cbc': 'Complete Blood Count',
    'bnp': 'Brain Natriuretic Peptide', 'ekg': 'Electrocardiogram', 'ecg': 'Electrocardiogram', 'ct': 'Computed Tomography', 'mri': 'Magnetic Resonance Imaging',
    'cxr': 'Chest X-Ray', 'ed': 'Emergency Department', 'icu': 'Intensive Care Unit', 'ccu': 'Cardiac Care Unit', 'los': 'Length of Stay', 'ama': 'Against Medical Advice',
    'wbc': 'White Blood Cell Count', 'hgb': 'Hemoglobin', 'plt': 'Platelet Count', 'inr': 'International Normalized Ratio', 'ptt': 'Partial Thromboplastin Time',
    'ast': 'Aspartate Aminotransferase', 'alt': 'Alanine Aminotransferase', 'bun': 'Blood Urea Nitrogen', 'cr': 'Creatinine', 'gfr': 'Glomerular Filtration Rate',
    'hba1c': 'Hemoglobin A1c', 'ldl': 'Low-Density Lipoprotein', 'hdl': 'High-Density Lipoprotein', 'tc': 'Total Cholesterol', 'tg': 'Triglycerides',
    'fpg': 'Fasting Plasma Glucose', 'des': 'Drug-Eluting Stent', 'pci': 'Percutaneous Coronary Intervention', 'cabg': 'Coronary Artery Bypass Graft',
    'lad': 'Left Anterior Descending', 'rca': 'Right Coronary Artery', 'icd': 'International Classification of Diseases', 'cpt': 'Current Procedural Terminology',
    'drg': 'Diagnosis Related Group', 'ra': 'Room Air', 'nc': 'Nasal Cannula',
}

TEXT_MISSPELLINGS = {
    'diabeties': 'diabetes', 'diebetes': 'diabetes', 'diabettes': 'diabetes', 'diabetis': 'diabetes', 'diabet': 'diabetic', 'hypertention': 'hypertension',
    'hypertenshion': 'hypertension', 'hypotention': 'hypotension', 'athritis': 'arthritis', 'arthritus': 'arthritis', 'artheritis': 'arthritis', 'asthima': 'asthma',
    'asthama': 'asthma', 'pnuemonia': 'pneumonia', 'neumonia': 'pneumonia', 'tachychardia': 'tachycardia', 'bradychardia': 'bradycardia', 'cardiomyopthy': 'cardiomyopathy',
    'cardiomiopathy': 'cardiomyopathy', 'fibrilation': 'fibrillation', 'fibrallation': 'fibrillation', 'deppression': 'depression', 'depresion': 'depression',
    'depretion': 'depression', 'alzeimer': 'alzheimer', 'alheimer': 'alzheimer', 'alzheimers': "alzheimer's", 'parkinsons': "parkinson's", 'parkinson': "parkinson's",
    'hypothyrodism': 'hypothyroidism', 'hypothyriodism': 'hypothyroidism', 'hyperthyrodism': 'hyperthyroidism', 'osteoporsis': 'osteoporosis', 'rheumatiod': 'rheumatoid',
    'rhuematoid': 'rheumatoid', 'schizophrnia': 'schizophrenia', 'shizophrenia': 'schizophrenia', 'hepititis': 'hepatitis', 'hepatitits': 'hepatitis',
    'apendecitis': 'appendicitis', 'appendecitis': 'appendicitis', 'diverticulitus': 'diverticulitis', 'colitus': 'colitis', 'cronhs': "crohn's", 'crohns': "crohn's",
    'cholestorol': 'cholesterol', 'chloesterol': 'cholesterol', 'hyperlipedemia': 'hyperlipidemia', 'hyperlipedaemia': 'hyperlipidemia', 'anaemia': 'anemia',
    'leukaemia': 'leukemia', 'septicaemia': 'septicemia', 'bacteraemia': 'bacteremia', 'oedema': 'edema', 'haemoglobin': 'hemoglobin', 'haematology': 'hematology',
    'haemorrhage': 'hemorrhage', 'dyspnoea': 'dyspnea', 'disnoea': 'dyspnea', 'diarrhoea': 'diarrhea', 'diarrheau': 'diarrhea', 'vomitting': 'vomiting', 'nauseau': 'nausea',
    'psorasis': 'psoriasis', 'ezczema': 'eczema', 'rhinittis': 'rhinitis', 'sinusitus': 'sinusitis', 'bronchitus': 'bronchitis', 'emphsyema': 'emphysema',
    'tuberclosis': 'tuberculosis', 'myocardal': 'myocardial', 'infaction': 'infarction', 'metastses': 'metastases', 'carinoma': 'carcinoma', 'colonoscpy': 'colonoscopy',
    'laparosocpic': 'laparoscopic', 'appendictomy': 'appendectomy', 'histerectomy': 'hysterectomy', 'angioplastyy': 'angioplasty', 'metformine': 'metformin',
    'insuline': 'insulin', 'lisinoprl': 'lisinopril', 'atorvastatine': 'atorvastatin', 'amoxycillin': 'amoxicillin', 'paracetamole': 'paracetamol',
    'acetominaphen': 'acetaminophen', 'ibuprophen': 'ibuprofen', 'ibuprofin': 'ibuprofen', 'prednisole': 'prednisolone', 'dexamethosone': 'dexamethasone',
    'sertarline': 'sertraline', 'fluoxitine': 'fluoxetine', 'gabapentine': 'gabapentin', 'pregabline': 'pregabalin', 'morpine': 'morphine', 'oxycodon': 'oxycodone',
    'warfarine': 'warfarin', 'heparine': 'heparin', 'salbutamole': 'salbutamol', 'albuterole': 'albuterol',
}

# type: (pattern, category, risk)
PHI_PATTERNS = {
    'SSN': ('(?<![A-Za-z0-9-])(?:\\d{3}[-\\s]?\\d{2}[-\\s]?\\d{4}|\\*{3}-\\*{2}-\\d{4}|X{3}-X{2}-\\d{4})(?![A-Za-z0-9-])', 'Social Security Number', 'CRITICAL'),
    'MRN': ('\\b(?:MRN|mrn|Medical Record|medical record)[:\\s#]*(\\d{6,12})\\b', 'Medical record numbers', 'HIGH'),
    'PHONE': ('\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}', 'Telephone numbers', 'HIGH'),
    'EMAIL': ('[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}', 'Email addresses', 'HIGH'),
    'DOB': ('\\b(?:DOB|dob|Date of Birth|date of birth)[:\\s]*(\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{2,4}|\\d{4}[/\\-]\\d{2}[/\\-]\\d{2})\\b', 'Dates related to individual', 'HIGH'),
    'DATE_FULL': ('\\b\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{4}\\b', 'Dates', 'MEDIUM'),
    'IP_ADDRESS': ('\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', 'Internet Protocol (IP) address', 'MEDIUM'),
    'NPI': ('\\b(?:NPI)[:\\s#]*(\\d{10})\\b', 'Provider identifiers', 'LOW'),
    'INSURANCE_ID': ('\\b(?:Policy|Insurance|Member\\s*ID|Group)[:\\s#]*([A-Z]{2,8}(?:[-\\s]\\w{2,20}){1,4})\\b', 'Health plan beneficiary numbers', 'HIGH'),
    'CREDIT_CARD': ('\\b(?:\\d{4}[-\\s]?){3}\\d{4}\\b', 'Financial account numbers', 'CRITICAL'),
    'PATIENT_NAME': ('\\b(?:Patient|Name|patient|name)[:\\s]+([A-Z][a-z]+\\s+[A-Z][a-z]+)\\b', 'Names', 'HIGH'),
    'PROVIDER_NAME': ('\\b(?:Dr\\.|Doctor|Physician|Attending|Provider)[:\\s]*([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 'Names', 'MEDIUM'),
    'AADHAAR': ('\\b\\d{4}\\s?\\d{4}\\s?\\d{4}\\b', 'National ID (DPDP)', 'CRITICAL'),
    'ADDRESS': ('\\b\\d{1,5}\\s(?:[A-Za-z0-9#-]+\\s){1,5}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir)\\b(?:,?\\s[A-Za-z\\s]+,?\\s[A-Z]{2}\\s\\d{5}(?:-\\d{4})?)?', 'Geographic subdivisions smaller than a state', 'HIGH'),
}

MEASUREMENTS = {
    'blood_pressure': '(?:BP|blood\\s*pressure)[:\\s]*(\\d{2,3})[/](\\d{2,3})', 'heart_rate': '(?:HR|heart\\s*rate|pulse)[:\\s]*(\\d{2,3})\\s*(?:bpm)?',
    'respiratory_rate': '(?:RR|respiratory\\s*rate)[:\\s]*(\\d{1,2})', 'temperature': '(?:Temp|temperature)[:\\s]*(\\d{2,3}\\.?\\d?)\\s*(?:°?[FC])?',
    'oxygen_saturation': '(?:SpO2|O2\\s*sat|oxygen\\s*sat)[:\\s]*(\\d{2,3})\\s*%?', 'glucose': '(?:Glucose|glucose|blood\\s*sugar)[:\\s]*(\\d{2,4})\\s*(?:mg/dL)?',
    'hba1c': '(?:HbA1c|A1c|hemoglobin\\s*a1c)[:\\s]*(\\d{1,2}\\.?\\d?)\\s*%?', 'troponin': '(?:Troponin|troponin)[:\\s]*(\\d+\\.?\\d*)\\s*(?:ng/mL)?',
    'bmi': '(?:BMI|bmi)[:\\s]*(\\d{2}\\.?\\d?)', 'weight': '(?:Weight|weight|Wt)[:\\s]*(\\d{2,3}\\.?\\d?)\\s*(?:kg|lbs?)?',
    'creatinine': '(?:Cr|creatinine|Creatinine)[:\\s]*(\\d+\\.?\\d?)',
}

DISEASES = [
    'diabetes(?: mellitus)?(?: type [12i]+)?', 'hypertension', 'hypotension', 'coronary artery disease', 'heart failure', 'congestive heart failure', 'atrial fibrillation',
    'myocardial infarction', 'angina(?: pectoris)?', 'stroke', 'transient ischemic attack', 'pulmonary embolism', 'deep vein thrombosis',
    'chronic obstructive pulmonary disease', 'copd', 'asthma', 'pneumonia', 'chronic kidney disease', 'acute kidney injury', 'renal failure', 'hepatitis(?: [abc])?',
    'cirrhosis', 'pancreatitis', 'cholecystitis', "crohn'?s disease", 'ulcerative colitis', 'celiac disease', 'diverticulitis', "alzheimer'?s disease",
    "parkinson'?s disease", 'multiple sclerosis', 'epilepsy', 'depression', 'anxiety disorder', 'schizophrenia', 'bipolar disorder', 'ptsd', 'adhd', 'hypothyroidism',
    'hyperthyroidism', 'metabolic syndrome', 'obesity', 'rheumatoid arthritis', 'osteoarthritis', 'osteoporosis', 'gout', 'lupus', 'anemia', 'leukemia', 'lymphoma',
    'melanoma', 'breast cancer', 'lung cancer', 'colon cancer', 'prostate cancer', 'cervical cancer', 'ovarian cancer', 'colorectal cancer', 'gastric cancer',
    'pancreatic cancer', 'sepsis', 'meningitis', 'encephalitis', 'tuberculosis', 'covid-?19', 'influenza', 'hiv', 'aids', 'malaria', 'dengue fever', 'appendicitis',
    'hyperlipidemia', 'dyslipidemia', 'urinary tract infection', 'kidney stone', 'nephrolithiasis', 'glaucoma', 'cataracts?', 'eczema', 'psoriasis', 'dermatitis',
    'cellulitis', 'deep vein thrombosis', 'tachycardia', 'bradycardia', 'cardiomyopathy',
]

DRUGS = [
    'metformin', 'insulin(?: glargine| aspart| lispro| nph)?', 'lisinopril', 'enalapril', 'ramipril', 'amlodipine', 'nifedipine', 'diltiazem', 'verapamil', 'atorvastatin',
    'simvastatin', 'rosuvastatin', 'pravastatin', 'lovastatin', 'aspirin', 'clopidogrel', 'warfarin', 'heparin', 'enoxaparin', 'apixaban', 'rivaroxaban', 'metoprolol',
    'atenolol', 'bisoprolol', 'carvedilol', 'propranolol', 'furosemide', 'hydrochlorothiazide', 'spironolactone', 'torsemide', 'omeprazole', 'pantoprazole', 'lansoprazole',
    'esomeprazole', 'ranitidine', 'amoxicillin', 'amoxicillin[- ]clavulanate', 'azithromycin', 'ciprofloxacin', 'doxycycline', 'vancomycin', 'piperacillin', 'meropenem',
    'ceftriaxone', 'prednisone', 'prednisolone', 'dexamethasone', 'methylprednisolone', 'budesonide', 'albuterol', 'salbutamol', 'salmeterol', 'tiotropium', 'fluticasone',
    'beclomethasone', 'levothyroxine', 'methimazole', 'propylthiouracil', 'sertraline', 'fluoxetine', 'escitalopram', 'citalopram', 'venlafaxine', 'duloxetine',
    'alprazolam', 'diazepam', 'lorazepam', 'clonazepam', 'gabapentin', 'pregabalin', 'carbamazepine', 'phenytoin', 'valproate', 'lamotrigine', 'acetaminophen',
    'paracetamol', 'ibuprofen', 'naproxen', 'celecoxib', 'indomethacin', 'morphine', 'oxycodone', 'hydrocodone', 'codeine', 'tramadol', 'fentanyl', 'digoxin', 'amiodarone',
    'sotalol', 'flecainide', 'adenosine', 'allopurinol', 'colchicine', 'febuxostat', 'methotrexate', 'hydroxychloroquine', 'sulfasalazine', 'leflunomide', 'adalimumab',
    'etanercept', 'infliximab', 'rituximab', 'trastuzumab', 'ondansetron', 'metoclopramide', 'domperidone', 'lactulose', 'bisacodyl', 'docusate', 'polyethylene glycol',
    'zolpidem', 'eszopiclone', 'melatonin', 'quetiapine', 'olanzapine', 'haloperidol',
]

PROCEDURES = [
    'echocardiogram', 'electrocardiogram', 'ekg', 'ecg', 'chest x-?ray', 'ct scan', 'mri', 'pet scan', 'ultrasound', 'coronary angiogram', 'angioplasty', 'stent placement',
    'bypass surgery', 'cabg', 'colonoscopy', 'endoscopy', 'gastroscopy', 'bronchoscopy', 'cystoscopy', 'sigmoidoscopy', 'appendectomy', 'cholecystectomy', 'hysterectomy',
    'thyroidectomy', 'nephrectomy', 'dialysis', 'hemodialysis', 'peritoneal dialysis', 'chemotherapy', 'radiation therapy', 'radiotherapy', 'immunotherapy', 'biopsy',
    'fine needle aspiration', 'bone marrow biopsy', 'blood transfusion', 'platelet transfusion', 'plasma transfusion', 'physical therapy', 'occupational therapy',
    'speech therapy', 'cardiac catheterization', 'pacemaker implantation', 'defibrillation', 'cardioversion', 'intubation', 'mechanical ventilation', 'tracheostomy',
    'central line', 'peripherally inserted central catheter', 'picc line', 'lumbar puncture', 'spinal tap', 'coronary artery bypass', 'carotid endarterectomy',
    'knee replacement', 'hip replacement', 'joint replacement', 'cataract surgery', 'lasik', 'mammogram', 'mammography', 'pap smear', 'pap test', 'blood culture',
    'urine culture', 'sputum culture',
]
