"""Vocabularies of the extraction rules. Fixed values, kept in their natural order; they decide which results are right."""

SECTION_ALIASES = {
    "summary": ["summary", "professional summary", "career summary", "profile", "professional profile", "about me", "about", "overview"],
    "objective": ["objective", "career objective", "professional objective", "job objective"],
    "skills": [
        "skills", "technical skills", "skill set", "core skills", "key skills", "technical proficiencies", "technologies", "technologies & tools",
        "technologies and tools", "tools & technologies", "tools and technologies", "technical expertise", "areas of expertise", "competencies",
        "core competencies", "programming skills", "programming languages", "technical stack", "tech stack", "expertise",
    ],
    "education": ["education", "educational background", "educational qualifications", "academic background", "academic qualifications", "academic history", "qualifications", "degrees"],
    "experience": [
        "experience", "work experience", "professional experience", "employment history", "work history", "job history", "career history",
        "relevant experience", "industry experience", "internship", "internships", "internship experience",
    ],
    "projects": ["projects", "personal projects", "academic projects", "project experience", "notable projects", "key projects", "side projects", "open source projects", "open-source projects"],
    "certifications": ["certifications", "certificates", "professional certifications", "licenses", "licenses & certifications", "licenses and certifications", "credentials"],
    "achievements": ["achievements", "awards", "honors", "honours", "awards & achievements", "awards and achievements", "accomplishments", "recognition"],
    "languages": ["languages", "language skills", "spoken languages", "foreign languages"],
    "interests": ["interests", "hobbies", "hobbies & interests", "hobbies and interests", "extracurricular activities", "activities"],
    "publications": ["publications", "research", "research experience", "papers", "conference papers"],
    "volunteering": ["volunteering", "volunteer experience", "leadership", "community service"],
    "references": ["references", "professional references"],
}

#: A heading that holds one of these words is taken for a sentence.
SENTENCE_WORDS = (
    "the and with have has had was were is are be been will would can could should my our your their its in on at for of to from by an a"
).split()

#: Lines up to so many characters can be headings; so many lines are searched for the name.
MAX_HEADING, NAME_WINDOW = 60, 12

HEADING_WORDS = (
    "summary objective profile skills education experience projects certifications achievements languages interests hobbies publications "
    "volunteering references qualifications overview about career professional contact details information background employment work history "
    "academic technical core competencies expertise internship internships activities"
).split()
JOB_WORDS = (
    "engineer developer analyst designer architect manager consultant specialist lead senior junior intern associate director head officer "
    "executive coordinator scientist researcher programmer technician administrator fresher graduate student candidate"
).split()

GITHUB_RESERVED = (
    "about pricing features explore topics trending collections events sponsors readme security customer-stories enterprise team settings "
    "notifications login signup join search pulls issues marketplace orgs organizations blog site contact support mobile desktop apps nonprofit education"
).split()
LINKEDIN_RESERVED = ["in", "profile", "user"]

TITLE_WORDS = (
    "engineer developer programmer architect lead senior junior associate principal staff analyst scientist researcher designer consultant "
    "specialist manager director head officer executive coordinator administrator technician intern trainee freelance contractor independent full "
    "stack backend frontend mobile android ios cloud devops sre qa test data ml ai software web product project business system network security "
    "embedded hardware"
).split()
NOT_TITLE_WORDS = (
    "skills education experience projects certifications achievements languages summary objective references python java mysql docker kubernetes "
    "git b.tech m.tech mba bca mca b.sc m.sc cgpa gpa percentage"
).split()

#: The skills known by default, by category. A dictionary file in the same form (JSON) can be given instead.
SKILLS = {
    "programming_languages": ["C", "C++", "C#", "Java", "Python", "JavaScript", "TypeScript", "Go", "Rust", "Kotlin", "Swift", "PHP", "Ruby", "Scala", "R", "MATLAB", "Perl", "Shell", "Bash", "PowerShell", "Dart", "Lua", "Elixir", "Haskell", "Assembly", "COBOL", "Groovy", "Objective-C", "Visual Basic", "F#"],
    "web_frontend": ["HTML", "CSS", "HTML5", "CSS3", "SASS", "SCSS", "LESS", "React", "React.js", "Angular", "Vue", "Vue.js", "Next.js", "Nuxt.js", "Svelte", "jQuery", "Bootstrap", "Tailwind CSS", "Material UI", "Webpack", "Vite"],
    "web_backend": ["Node.js", "Express.js", "Django", "Flask", "FastAPI", "Spring Boot", "ASP.NET", ".NET", "Laravel", "Ruby on Rails", "Gin", "Fiber", "NestJS", "Hapi.js", "Tornado", "Starlette", "GraphQL", "REST API", "gRPC"],
    "databases": ["SQL", "MySQL", "PostgreSQL", "SQLite", "Oracle", "SQL Server", "Microsoft SQL Server", "MariaDB", "MongoDB", "Redis", "Cassandra", "DynamoDB", "Elasticsearch", "Firebase", "CouchDB", "Neo4j", "InfluxDB", "Supabase"],
    "cloud": ["AWS", "Amazon Web Services", "Azure", "Microsoft Azure", "Google Cloud", "GCP", "Heroku", "Vercel", "Netlify", "DigitalOcean", "Linode", "IBM Cloud", "AWS Lambda", "EC2", "S3", "Azure DevOps"],
    "devops": ["Docker", "Kubernetes", "Jenkins", "Git", "GitHub", "GitLab", "Bitbucket", "Ansible", "Terraform", "Chef", "Puppet", "Vagrant", "CI/CD", "Linux", "Unix", "Nginx", "Apache", "Helm", "Prometheus", "Grafana", "Kafka", "RabbitMQ", "ArgoCD", "GitHub Actions"],
    "data_science": ["NumPy", "Pandas", "Matplotlib", "Seaborn", "SciPy", "Plotly", "Tableau", "Power BI", "Excel", "Data Analysis", "Data Visualization", "Statistical Analysis", "ETL", "Apache Spark", "Apache Hadoop", "Hive", "Pig", "Airflow", "dbt"],
    "machine_learning": ["Machine Learning", "Deep Learning", "NLP", "Natural Language Processing", "Computer Vision", "Scikit-learn", "TensorFlow", "PyTorch", "Keras", "XGBoost", "LightGBM", "NLTK", "SpaCy", "Hugging Face", "OpenCV", "Reinforcement Learning", "Neural Networks", "Transfer Learning", "Object Detection"],
    "mobile": ["Android", "iOS", "React Native", "Flutter", "SwiftUI", "Jetpack Compose", "Xamarin", "Ionic"],
    "cs_fundamentals": ["Data Structures", "Algorithms", "Object-Oriented Programming", "Functional Programming", "Design Patterns", "System Design", "Microservices", "Operating Systems", "Computer Networks", "Distributed Systems", "Concurrency", "Multithreading", "Agile", "Scrum", "Test-Driven Development", "Unit Testing"],
    "tools_and_other": ["Postman", "Swagger", "Jira", "Confluence", "Slack", "VS Code", "IntelliJ IDEA", "Eclipse", "PyCharm", "Jupyter", "Jupyter Notebook", "Google Colab", "Maven", "Gradle", "npm", "pip", "Yarn", "JSON", "XML", "YAML", "Markdown", "Regex", "Linux Administration", "Bash Scripting", "Cybersecurity", "Networking", "Cloud Computing", "Blockchain", "Arduino", "Raspberry Pi"],
}

#: Other spellings of skills. A skill's own name in lower case needs no entry.
SKILL_ALIASES = {
    "js": "JavaScript", "ts": "TypeScript", "py": "Python", "python3": "Python", "nodejs": "Node.js", "node js": "Node.js", "react.js": "React", "reactjs": "React", "react js": "React",
    "vue.js": "Vue", "vuejs": "Vue", "vue js": "Vue", "nextjs": "Next.js", "next js": "Next.js", "expressjs": "Express.js", "express js": "Express.js", "c plus plus": "C++", "cplusplus": "C++",
    "c sharp": "C#", "csharp": "C#", "dotnet": ".NET", "dot net": ".NET", "aspnet": "ASP.NET", "springboot": "Spring Boot", "spring": "Spring Boot", "sklearn": "Scikit-learn", "scikit learn": "Scikit-learn",
    "ml": "Machine Learning", "dl": "Deep Learning", "natural language processing": "NLP", "postgres": "PostgreSQL", "mongo": "MongoDB", "amazon web services": "AWS", "google cloud platform": "GCP",
    "microsoft azure": "Azure", "k8s": "Kubernetes", "oop": "Object-Oriented Programming", "object oriented programming": "Object-Oriented Programming", "oops": "Object-Oriented Programming",
    "dsa": "Data Structures", "data structures and algorithms": "Data Structures", "cicd": "CI/CD", "rest apis": "REST API", "restful api": "REST API", "restful": "REST API", "tdd": "Test-Driven Development",
}
STRICT_SKILLS = ["C", "R", "Go"]
