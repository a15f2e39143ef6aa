"""Values that outside data or outside formats fix.

Everything here is plain data: catalog column defaults, license rules,
category descriptions, ranking constants, prompt texts and output formats.
Code elsewhere reads these tables; none of them holds logic.
"""

# --- fixed values: ordered license rules, the first match wins -------------
LICENSE_RULES = [
    ("MIT License", r"^(MIT License|MIT)"),
    ("Apache License 2.0", r"^Apache License(?:, Version \d\.\d)?"),
    ("BSD 2-Clause License", r"^BSD 2-Clause License"),
    ("BSD 3-Clause License", r"^BSD 3-Clause License"),
    ("BSD License", r"^BSD"),
    ("GNU GPL", r"^GNU General Public License"),
    ("Mozilla Public License", r"^Mozilla Public License"),
    ("Eclipse Public License", r"^Eclipse Public License"),
    ("The Unlicense", r"^The Unlicense"),
    ("ISC License", r"^ISC License"),
    ("Artistic License 2.0", r"^Artistic License 2\.0"),
    ("Boost Software License", r"^Boost Software License"),
    ("CC0 1.0 Universal", r"^CC0 1\.0 Universal"),
    ("CC-BY 4.0", r"^Creative Commons Attribution 4\.0"),
    ("CC-BY-SA 4.0", r"^Creative Commons Attribution Share Alike 4\.0"),
    ("CC-BY-NC 4.0", r"^Creative Commons Attribution Non Commercial 4\.0"),
    ("Erlang Public License", r"^Erlang Public License"),
    ("GNU AGPL", r"^GNU Affero General Public License"),
    ("GNU LGPL", r"^GNU Lesser General Public License"),
    ("LPPL 1.3c", r"^LaTeX Project Public License 1\.3c"),
    ("MPL 2.0", r"^Mozilla Public License 2\.0"),
    ("ODC-BY 1.0", r"^Open Data Commons Attribution License 1\.0"),
    ("ODbL 1.0", r"^Open Data Commons Open Database License 1\.0"),
    ("OFL 1.1", r"^SIL Open Font License 1\.1"),
    ("PostgreSQL License", r"^PostgreSQL License"),
    ("Simplified BSD License", r"^Simplified BSD License"),
    ("WTFPL", r"^WTFPL"),
    ("Zlib License", r"^Zlib License"),
    ("Apache License 1.0", r"^Apache License, Version 1\.0"),
    ("BSD+Patent License", r"^BSD\+Patent"),
    ("CeCILL-C", r"^CeCILL-C"),
    ("CeCILL", r"^CeCILL"),
    ("EUPL 1.1", r"^European Union Public Licence 1\.1"),
    ("GPLv3 or later", r"^GNU General Public License v3\.0 or later"),
    ("IBM Public License", r"^IBM Public License"),
    ("LGPLv3", r"^GNU Lesser General Public License v3\.0"),
    ("NCSA License", r"^NCSA Open Source License"),
]

# --- fixed values: names used when no license or README text is known ------
UNKNOWN_LICENSE = "Unknown License"
OTHER_LICENSE = "Other"
MISSING_README = "no readme found"

# --- fixed values: zero-shot categories, in tie-breaking order -------------
CATEGORIES = [
    ("AI - Machine Learning", "scikit-learn, lighgbm,  xgboost, gradient boosting Linear Regression, Logistic Regression, Decision Trees, Random Forest, Naïve Bayes, k-Nearest Neighbors, Support Vector Machines, Principal Component Analysis, k-Means, DBSCAN, Hierarchical Clustering, AdaBoost, Gradient Boosting, XGBoost, LightGBM, CatBoost, Hidden Markov Models, Expectation Maximization, Gaussian Mixture Models, Latent Dirichlet Allocation, streaming processing,  Supervised and unsupervised machine learning projects using scikit-learn, daal4py, or R for classification, regression, or clustering tasks"),
    ("AI - Natural Language Processing", "RNN, LSTM, GRU, Transformer, BERT, GPT, RoBERTa, T5, XLNet, ALBERT, DistilBERT, ERNIE, GPT-2, GPT-3, Transformer-XL, ELECTRA, XLM, XLM-R, BART, ELMO, ULMFiT, reading comprehension, summarize, embedding, Text analysis, Natural Language Processing, sentiment analysis, text generation, or chatbot projects using Huggingface Transformers, TensorFlow, or PyTorch"),
    ("AI - Computer Vision", "AlexNet, VGG, ResNet, DenseNet, MobileNet, EfficientNet, U-Net, R-CNN, YOLO, GAN, HRNet, DeepLab, RetinaNet, Text-To-Image, stable diffusion, controlnet, neural processing, DETR, YOLOv, SegFormer, ViT, face detection, face alignment, hair segmentation, pose estimation, OCR, Computer vision, Image classification, Image processing, object detection, or face recognition projects using OpenCV, Pillow, TensorFlow, visual, PaddlePaddle, or PyTorch"),
    ("AI - Data Science", "Data analysis, SparkSQL, clickhouse, analytics, big data, recommendation systems,ray, rayonspark, bigdl, spark, sql, data science, data visualization, or data preprocessing projects using pandas, numpy, or matplotlib"),
    ("AI - RL", "Q-Learning, Deep Q-Network (DQN), Double DQN, Dueling DQN, SARSA, Expected SARSA, Temporal Difference (TD) Learning, Policy Gradients, REINFORCE, Proximal Policy Optimization (PPO), Advantage Actor-Critic (A2C), Asynchronous Advantage Actor-Critic (A3C), Trust Region Policy Optimization (TRPO), Soft Actor-Critic (SAC), Deep Deterministic Policy Gradient (DDPG), Twin Delayed DDPG (TD3), Distributional RL (C51, QR-DQN), Hierarchical Reinforcement Learning (HRL), Inverse Reinforcement Learning (IRL), Imitation Learning, Model-Based RL"),
    ("Medical and Life Sciences", "Medical and Biomedical research, genomics, or drug discovery projects involving machine learning or data analysis related to health or life sciences"),
    ("Mathematics and Science", "Numerical simulations, mathematical modeling, or scientific computing projects using mkl, oneMKL, tbb, or other libraries"),
    ("Tools & Development", "Compiler, optimization, or media libraries development projects, including oneMKL, oneDNN, oneDPL, or oneCCL, level zero"),
    ("Financial Services", "Projects involving financial data analysis, risk management, or trading algorithms Black-Scholes Model, Binomial Option Pricing, Monte Carlo Simulation, GARCH, ARIMA, VAR, Cointegration, CAPM, Fama-French Model, Time Series Analysis, Technical Analysis, Risk Metrics, Portfolio Optimization, Markov Chain, Machine Learning Models (e.g., SVM, Random Forest, Gradient Boosting, etc.), Neural Networks, Reinforcement Learning, Sentiment Analysis, Algorithmic Trading, Bayesian Networks"),
    ("Manufacturing", "Manufacturing process optimization, quality control, or factory automation projects"),
    ("Tutorials", "Guides, tutorials, or examples showcasing projects or libraries usage"),
    ("HPC", "Finite Element Method, Finite Difference Method, Finite Volume Method, Boundary Element Method, Lattice Boltzmann Method, Monte Carlo Simulations, Molecular Dynamics, Discrete Event Simulation, Fast Fourier Transform, Conjugate Gradient, Krylov Subspace Methods, Multigrid Methods, Discontinuous Galerkin Methods, Particle-in-Cell, Smoothed Particle Hydrodynamics, N-Body Simulations, High Performance Linpack, Graph Analytics, High-performance computing projects, including parallel computing, distributed systems, or GPGPU programming with SYCL or OpenCL, oneMKL, OpenMP, MPI "),
]

# --- fixed values: ranking constants ---------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RELEVANCE_BM25_WEIGHT = 0.7
RELEVANCE_TFIDF_WEIGHT = 0.3
RELEVANCE_THRESHOLD = 0.5
HYBRID_BM25_WEIGHT = 0.30
HYBRID_COSINE_WEIGHT = 0.70
REPORT_RELEVANCE_CUTOFF = 0.4
UNPARSED_SCORE = 0.1234
MAX_MODEL_CHARS = 10000

# --- fixed values: text patterns -------------------------------------------
# Character classes list single characters below 256 on purpose: the JVM tests
# those by one table look-up, but every range or predefined class by a call
# (cleaning 30,000 texts took 1.0-1.6 s against 8.5-9.6 s with ranges and \\s).
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
# White space as Python's str.split() and \s know it: below 256, and above.
SPACES = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
WIDE_SPACES = "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CODE_FENCE = r"(?s)```.*?```"
NOT_PLAIN_ENGLISH = f"[^{LETTERS}{DIGITS}.,!?{SPACES}]+"
TFIDF_TOKEN = "[a-z0-9_]{2,}"
WORD_OR_SYMBOL = rf"[{LETTERS}{DIGITS}_]+|[^{LETTERS}{DIGITS}_ \t\n\x0b\x0c\r]"
LANGUAGE_SEPARATOR = "| "
KEYWORD_SEPARATOR = "|"
SCORE_FIELD = r"Relevancy_score\s*=\s*([\d.]+)"
REASONS_FIELD = r"Reasons\s*=\s*\[(.+)\]"

# Everything in ASCII that separates words of a natural language.
ASCII_NO_LETTERS = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalpha())

# --- fixed values: most frequent function words per language ---------------
LANGUAGE_WORDS = [
    ("en", ["the", "of", "and", "to", "is", "that", "it", "for", "was", "with"]),
    ("fr", ["le", "les", "des", "et", "un", "une", "du", "qui", "dans", "pour"]),
    ("de", ["der", "die", "und", "den", "zu", "von", "das", "mit", "sich", "ein"]),
    ("es", ["el", "los", "las", "del", "y", "se", "por", "una", "con", "para"]),
]

# --- fixed values: report text ---------------------------------------------
REPORT_TITLE = "# Awesome GitHub Repos"
REPORT_CONTENTS_TITLE = "## Table of Contents"
STAR_BADGE = "![GitHub stars](https://img.shields.io/badge/stars-{stars}-blue)"

# --- fixed values: prompt texts --------------------------------------------
CATEGORY_SYSTEM = "You are a helpful and an expert assistant who classifies GitHub repos into categories based on their README content."
CATEGORY_USER = "Please provide the most relevant category for the following GitHub project README without explanation. Choose from: 'AI - Machine Learning', 'AI - Natural Language Processing', 'Rendering', 'AI - Computer Vision', 'AI - Data Science', 'AI - Reinforcement Learning', 'Medical and Life Sciences', 'Mathematics and Science', 'Tools & Development', 'Financial Services', 'Manufacturing', 'Tutorials', 'HPC', 'AI-Frameworks'. The input README is:\n\n{readme_text}"
SUMMARY_SYSTEM = "You are a helpful assistant that generates a brief 2 to 3 line summary of GitHub project READMEs."
SUMMARY_USER = "Please provide a brief 2 to 3 line summary of the following GitHub project README without explaining it:\n\n{readme_text}"
RELEVANCE_SYSTEM = "You are a helpful assistant who is an expert in finding relevant documents."
# The component list and the worked examples belong to the user's own topic.
RELEVANCE_USER = "Please provide a score between 0 to 1 (0 lowest, 1 highest) on how much the following GitHub project README, mentions the use or uses of any of the components from the list: {components}. If the project or its development has been discontinued, then the score should be set to zero. Format your response as 'Relevancy_score = x, Reasons = [reason1, reason2]'. The input README is:\n\n{readme_text}"
